"""Streaming forms: rate limiting with state and event-time timers, event-time windows, sessions, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators.activity import Bucket

#: A client without requests for this long is forgotten; requests that come later than LATE after the newest are left out.
IDLE_MS, LATE, RECENT_MS = 600_000, "10 minutes", 60_000


class _Limiter(StatefulProcessor):
    """A token bucket and the requests of the last minute for each client. A timer at the client's last request plus idle_ms clears
    both when the watermark passes it."""

    def __init__(self, per_minute: float, burst: float, idle_ms: int) -> None:
        self.per_minute, self.burst, self.idle_ms = per_minute, burst, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, reserve double, last double")
        self.recent = handle.getListState("recent", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values(["us", "event"])
        bucket = Bucket(self.per_minute, self.burst, *self.bucket.get()) if self.bucket.exists() else Bucket(self.per_minute, self.burst)
        known = [ms for (ms,) in self.recent.get()]
        fresh = known == []
        decisions, counts = [], []
        for us in part["us"]:
            decisions.append(bucket.take(us / 1e6))
            now = us // 1000
            known = [ms for ms in known if ms >= now - RECENT_MS] + [now]
            counts.append(len(known))
        self.bucket.update((float(bucket.tokens), float(bucket.reserve), float(bucket.last)))
        self.recent.put([(int(ms),) for ms in known])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(max(known)) + self.idle_ms)
        yield pd.DataFrame({"client": [key[0]] * len(part), "event": part["event"].to_numpy(), "decision": decisions, "recent": counts, "first": [fresh] + [False] * (len(part) - 1)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bucket.clear()
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(stream: DataFrame, client: str, ts: str, event: str, per_minute: float, burst: float, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """(client, event, decision, recent, first) of a stream of requests: one token bucket a client, kept as state.

    recent: the client's requests in the last minute; first: whether nothing was known of the client. A trigger's requests of a
    client are taken in time order. All times are those of the requests: the watermark stands `late` behind the
    newest one, what is older is left out, and a client idle for idle_ms is forgotten once the watermark says so, which a
    full bucket does not notice. Needs the RocksDB state store.
    """
    kind = stream.schema[client].dataType.simpleString()
    rows = stream.withWatermark(ts, late).select(F.col(client).alias("client"), F.col(event).cast("long").alias("event"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"))
    schema = f"client {kind}, event long, decision string, recent long, first boolean"
    return rows.groupBy("client").transformWithStateInPandas(_Limiter(per_minute, burst, idle_ms), schema, "Append", "EventTime")


def window_counts(events: DataFrame, ts: str, by: list[str], width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by event-time window; rows later than `late` are dropped in a stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).count().select(F.col("w.start").alias("window_start"), *by, F.col("count").alias("n"))


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events without a pause of `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).count().select(
        by, F.col("w.start").alias("session_start"), F.col("count").alias("n"),
    )


def running_status(events: DataFrame, job: str, status: str, ts: str) -> DataFrame:
    """Last status of each job so far (update or complete mode)."""
    return events.groupBy(job).agg(F.max_by(status, ts).alias("status"), F.count("*").alias("n_events"))
