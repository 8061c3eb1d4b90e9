"""Sessions, jobs, progress, speakers and rate limits over event tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import clock, duration
from lodestrata.functions.vectors import reset_seconds


def session_titles(messages: DataFrame, session: str, order: str, text: str, role: str, most: int = 50) -> DataFrame:
    """(session, title): the first user message, cut to `most` characters with an ellipsis."""
    first = messages.filter(F.col(role) == "user").groupBy(session).agg(F.min_by(text, order).alias("t"))
    return first.select(session, F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def appended(stored: DataFrame, new: DataFrame, role: str = "role") -> DataFrame:
    """Stored messages and new ones, without those of the system role."""
    return stored.unionByName(new.filter(F.col(role).isNull() | (F.col(role) != "system")))


def answer_events(deltas: DataFrame, by: str, order: str, kind: str, text: str) -> DataFrame:
    """(by, answer, n_citations, state) of streamed answer events: the tokens in order, and how the stream ended."""
    token = F.when(F.col(kind) == "token", F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))
    listed = F.transform(F.array_sort(F.collect_list(token)), lambda x: x["t"])
    state = F.when(F.bool_or(F.col(kind) == "error"), "error").when(F.bool_or(F.col(kind) == "done"), "done").otherwise("open")
    return deltas.groupBy(by).agg(F.array_join(listed, "").alias("answer"), F.count_if(F.col(kind) == "citation").alias("n_citations"), state.alias("state"))


def latest_status(events: DataFrame, keys: list[str], status: str, order: list[str]) -> DataFrame:
    """Last status of each key, with its number of events."""
    return events.groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n_events"))


def job_status(results: DataFrame, job: str, success: Column) -> DataFrame:
    """completed where every file of a job succeeded (also without files), else failed."""
    return results.groupBy(job).agg(
        F.when(F.coalesce(F.bool_and(success), F.lit(True)), "completed").otherwise("failed").alias("status"),
        F.count_if(success).alias("succeeded"), F.count("*").alias("n_files"),
    )


def failures(results: DataFrame, keep: list[str], failed: Column, error: Column, unknown: str = "Unknown error") -> DataFrame:
    """The failed results with their error; one without an error gets `unknown`. A null `failed` is no failure."""
    return results.filter(failed).select(*keep, F.coalesce(error, F.lit(unknown)).alias("error"))


def batch_totals(results: DataFrame, success: Column) -> DataFrame:
    """One row: results, successes, the others (null is none), and the percentage of successes (null without results)."""
    ok = F.count_if(success)
    return results.agg(
        F.count("*").alias("n_total"), ok.alias("n_ok"), (F.count("*") - ok).alias("n_failed"),
        F.round(F.try_divide(100 * ok, F.count("*")), 2).alias("percent_ok"),
    )


def hit_rates(lookups: DataFrame, by: str, hit: Column) -> DataFrame:
    """Share of lookups that hit, by group; a null hit is a miss."""
    rate = F.avg(F.when(hit, 1.0).otherwise(0.0))
    return lookups.groupBy(by).agg(F.round(rate, 6).alias("hit_rate"), F.count("*").alias("n"))


def stage_durations(events: DataFrame, keys: list[str], us: str) -> DataFrame:
    """First and last event of each key in microseconds, and the seconds between them; null times are left out."""
    return events.groupBy(*keys).agg(F.min(us).alias("started"), F.max(us).alias("ended"), F.round((F.max(us) - F.min(us)) / 1e6, 6).alias("seconds"))


def recording_durations(segments: DataFrame, file: str, start: str, end: str) -> DataFrame:
    """A recording lasts until the end of the segment that starts last."""
    return segments.groupBy(file).agg(F.round(F.max_by(end, start), 6).alias("duration"))


def failure_rates(results: DataFrame, by: list[str], failed: Column, alert_share: float = 0.1, least: int = 10) -> DataFrame:
    """Failure rate by group; the alert needs `least` results."""
    out = results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
    rate = F.round(F.coalesce(F.try_divide("n_failed", "n"), F.lit(0.0)), 6)
    return out.withColumn("failure_rate", rate).withColumn("alert", (F.col("n") >= least) & (F.col("n_failed") / F.col("n") > alert_share))


def phase_summary(progress: DataFrame, phase: str, status: str) -> DataFrame:
    """Counts by phase, and the total as phase `total`."""
    out = progress.rollup(phase).agg(
        F.count("*").alias("n_total"), F.count_if(F.col(status) == "completed").alias("n_completed"),
        F.count_if(F.col(status) == "failed").alias("n_failed"),
    )
    return out.withColumn(phase, F.coalesce(phase, F.lit("total")))


def pending(files: DataFrame, completed: DataFrame, failed: DataFrame, key: str, position: str) -> DataFrame:
    """Files not completed, the failed ones first, then by position."""
    rest = files.join(completed.select(key).distinct(), key, "left_anti")
    marked = rest.join(failed.select(key).distinct().withColumn("is_failed", F.lit(True)), key, "left").withColumn("is_failed", F.coalesce("is_failed", F.lit(False)))
    return marked.orderBy(F.desc("is_failed"), position)


def speakers(segments: DataFrame, by: str, start: str, end: str, gap: float = 2.0) -> DataFrame:
    """Speaker 1 or 2 for each segment: the speaker changes where a pause is longer than gap seconds."""
    order = Window.partitionBy(by).orderBy(start)
    pause = F.when(F.col(start) - F.lag(end, 1, 0.0).over(order) > gap, 1).otherwise(0)
    turns = segments.withColumn("__pause", pause).withColumn("__turn", F.sum("__pause").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return turns.withColumn("speaker", (F.col("__turn") % 2 + 1).cast("int")).drop("__pause", "__turn")


def transcripts(segments: DataFrame, file: str, start: str, end: str, text: str, language: str = "en", model: str = "whisper", gap: float = 2.0) -> DataFrame:
    """(file, markdown): a header and the segments in order, a line naming each new speaker before its words."""
    spoken = speakers(segments, file, start, end, gap)
    order = Window.partitionBy(file).orderBy(start)
    named = F.concat(F.lit("Speaker "), F.col("speaker").cast("string"))
    change = F.when(F.coalesce(F.lag("speaker").over(order) != F.col("speaker"), F.lit(True)), F.concat(F.lit("\n**"), named, F.lit(":**\n\n"))).otherwise("")
    line = F.concat(change, F.lit("["), clock(F.col(start)), F.lit("] "), F.trim(F.col(text)))
    listed = spoken.select(file, F.col(start).alias("__at"), F.col(end).alias("__end"), line.alias("__line"))
    one = listed.groupBy(file).agg(F.max_by("__end", "__at").alias("__seconds"), F.array_sort(F.collect_list(F.struct("__at", "__line"))).alias("__lines"))
    head = F.concat(
        F.lit("# Audio Transcription: "), F.col(file).cast("string"), F.lit("\n\n**Duration:** "), duration(F.col("__seconds")),
        F.lit(f"\n**Language:** {language}\n**Model:** {model}\n\n---\n\n"),
    )
    return one.select(file, F.concat(head, F.array_join(F.transform("__lines", lambda x: x["__line"]), "\n")).alias("markdown"))


def at_moment(moments: DataFrame, shots: DataFrame, by: str, time: str, start: str, end: str) -> DataFrame:
    """Each moment with the shot that contains it (start <= t < end), else the last shot; shots do not overlap.

    Shots and moments are merged in time order, and a moment takes the latest shot that has begun: no pairs of
    the two are made, and each row is sorted once.
    """
    a = shots.select(by, F.col(start).alias("__t"), F.lit(0).alias("__kind"), F.struct("shot", F.col(end).alias("end")).alias("__shot"))
    b = moments.select(by, F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(a.schema["__shot"].dataType).alias("__shot"))
    order = Window.partitionBy(by).orderBy("__t", "__kind")
    begun = F.last("__shot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last("__shot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = a.unionByName(b).select(by, "__t", "__kind", begun.alias("__begun"), last.alias("__last")).filter("__kind = 1")
    inside = F.col("__begun").isNotNull() & (F.col("__t") < F.col("__begun.end"))
    return placed.select(by, F.col("__t").alias(time), F.when(inside, F.col("__begun.shot")).otherwise(F.col("__last.shot")).alias("shot"))


# Requests a minute and bursts by tier and by kind of client, of the others, and paths without a limit.
TIERS = {"free": (60, 5), "premium": (300, 30), "enterprise": (1000, 100)}
DEFAULT_TIER = "free"
CLIENT_TYPES = {"ip_based": (100, 10), "session_based": (200, 20), "api_key_based": (500, 50)}
FALLBACK = (100, 10)
EXEMPT = ("/docs", "/redoc", "/openapi.json", "/health", "/metrics")


def tier_limits(tier: Column, tiers: dict[str, tuple[int, int]] | None = None, default: str = DEFAULT_TIER) -> Column:
    """struct(per_minute, burst) of a tier; unknown and missing tiers have the default's."""
    known = tiers or TIERS
    out = F.when(F.lit(False), _limits(known[default]))
    for name, pair in known.items():
        out = out.when(tier == name, _limits(pair))
    return out.otherwise(_limits(known[default]))


def _limits(pair: tuple[int, int]) -> Column:
    return F.struct(F.lit(float(pair[0])).alias("per_minute"), F.lit(float(pair[1])).alias("burst"))


def limiter(tier: Column, client_type: Column, tiers: dict[str, tuple[int, int]] | None = None) -> Column:
    """struct(limiter, per_minute, burst): that of the tier (the default tier where none is named), else that of the
    kind of client, else the fallback."""
    asked = F.coalesce(F.nullif(tier, F.lit("")), F.lit(DEFAULT_TIER))
    named = lambda name, pair: F.struct(F.lit(name).alias("limiter"), F.lit(float(pair[0])).alias("per_minute"), F.lit(float(pair[1])).alias("burst"))
    out = F.when(F.lit(False), named("fallback", FALLBACK))
    for name, pair in (TIERS if tiers is None else tiers).items():
        out = out.when(asked == name, named(f"tier:{name}", pair))
    for name, pair in CLIENT_TYPES.items():
        out = out.when(client_type == name, named(f"type:{name}", pair))
    return out.otherwise(named("fallback", FALLBACK))


def limited_requests(requests: DataFrame, denied: list[str], allowed: list[str], tiers: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The limits in front of a service, for a log (request long, ts, path, ip, client, tier, client_type).

    (request, decision, limit, remaining, reset, retry_after): exempt paths and allowed addresses pass, denied
    ones are blocked, and each client of a limiter has a bucket of its own. remaining is whole tokens and burst
    tokens; reset the seconds until the bucket is full; retry_after is set where the request is turned away or
    nothing remains.
    """
    access = ip_access(F.col("ip"), denied, allowed)
    by = limiter(F.col("tier"), F.col("client_type"), tiers)
    rows = requests.withColumn("__by", by).withColumn(
        "__pass", F.when(exempt(F.col("path")), "exempt").when(access == "blocked", "blocked").when(access == "whitelisted", "whitelisted"),
    )
    free = rows.filter(F.col("__pass").isNotNull()).select(
        "request", F.col("__pass").alias("decision"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("limit", "int"), ("remaining", "int"), ("reset", "double"), ("retry_after", "int"))],
    )
    held = rows.filter(F.col("__pass").isNull()).select(
        F.concat_ws(
            "|", "__by.limiter", F.coalesce("client", F.lit("unknown")),
        ).alias("client"), F.col("request").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("__by.per_minute").alias("per_minute"), F.col("__by.burst").alias("burst"),
    )
    taken = _through_buckets(held, "string")
    remaining = (F.floor("tokens") + F.floor("reserve")).cast("int")
    reset = reset_seconds(F.col("tokens"), F.col("per_minute"))
    wait = F.when(F.col("decision") == "rejected", F.greatest(F.lit(1), F.floor(reset).cast("int"))).when(remaining <= 0, F.floor(reset).cast("int"))
    counted = taken.select(
        F.col("event").alias("request"), "decision", F.col("per_minute").cast("int").alias("limit"), remaining.alias("remaining"),
        F.round(reset, 6).alias("reset"), wait.alias("retry_after"),
    )
    return counted.unionByName(free)


# Errors by severity, and stages in which any error is severe.
CRITICAL = ("DatabaseError", "ConnectionError", "MemoryError", "SystemError", "OSError")
HIGH = ("TimeoutError", "LLMCommandError", "ToolExecutionError", "ValidationError", "ConfigurationError")
MEDIUM = ("RateLimitExceededError", "IngestionError", "FileAccessError")
SEVERE_STAGES = ("query_generation", "final_assembly")


def severity(error: Column, stage: Column) -> Column:
    """critical, high, medium or low."""
    high = error.isin(*HIGH) | F.coalesce(stage.isin(*SEVERE_STAGES), F.lit(False))
    return F.when(error.isin(*CRITICAL), "critical").when(high, "high").when(error.isin(*MEDIUM), "medium").otherwise("low")


def builder_statistics(chunks: DataFrame, by: str, candidates: str, score: str, success: Column, us: str) -> DataFrame:
    """Chunks, candidates, mean score, share of successes and chunks a second of each builder."""
    seconds = (F.max(us) - F.min(us)) / 1e6
    return chunks.groupBy(by).agg(
        F.count("*").alias("n_chunks"), F.sum(candidates).cast("long").alias("n_candidates"), F.round(F.avg(score), 6).alias("avg_score"),
        F.round(
            F.coalesce(F.try_divide(F.count_if(success), F.count("*")), F.lit(0.0)), 6,
        ).alias("success_rate"), F.round(F.try_divide(F.count("*"), seconds), 6).alias("per_second"),
    )


def client_statistics(requests: DataFrame, client: str, us: str, now: Column, window_seconds: int = 60) -> DataFrame:
    """(client, recent, n): requests in the window that ends now, and all."""
    return requests.groupBy(client).agg(F.count_if(F.col(us) >= now - window_seconds * 1_000_000).alias("recent"), F.count("*").alias("n"))


# Fixed value: the error of a failure that has none.
NO_ERROR = "Unknown error"


def failure_report(progress: DataFrame, phase: str, file: str, error: Column, order: list[str]) -> DataFrame:
    """(phase, file, error): a row a failed file of each phase, its last error in the order of time, of those that say something."""
    said = F.when(F.coalesce(error, F.lit("")) != "", F.struct(*order))
    last = F.coalesce(F.max_by(error, said), F.lit(NO_ERROR))
    return progress.groupBy(F.col(phase).alias("phase"), F.col(file).cast("string").alias("file")).agg(last.alias("error"))


# A job's states, ended ones last.
STATES = ("queued", "processing", "completed", "failed")


def job_states(events: DataFrame, job: str, state: str, order: list[str]) -> DataFrame:
    """(job, state, n_events) from (job, state) events: the last state, but an ended job stays as it ended first."""
    place = F.struct(*order)
    ended = F.when(F.col(state).isin("completed", "failed"), place)
    found = events.filter(F.col(state).isin(*STATES)).groupBy(job).agg(
        F.min_by(state, ended).alias("__end"), F.max_by(state, place).alias("__last"), F.count("*").alias("n_events"),
    )
    return found.select(job, F.coalesce("__end", "__last").alias("state"), "n_events")


def ip_access(ip: Column, denied: list[str], allowed: list[str]) -> Column:
    """blocked, whitelisted or allowed: the deny list first; with an allow list, others are blocked."""
    out = F.when(ip.isNull(), "allowed").when(ip.isin(*denied) if denied else F.lit(False), "blocked")
    if allowed:
        return out.when(ip.isin(*allowed), "whitelisted").otherwise("blocked")
    return out.otherwise("allowed")


def client_id(ip: Column, forwarded: Column, session: Column, api_key: Column, kind: str) -> Column:
    """Client by the first forwarded hop or address, by session, or by the key's first eight characters."""
    address = F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), ip, F.lit("unknown"))
    if kind == "session":
        return F.when(F.coalesce(session, F.lit("")) != "", F.concat(F.lit("session:"), session)).otherwise(address)
    if kind == "api_key":
        return F.when(F.coalesce(api_key, F.lit("")) != "", F.concat(F.lit("api_key:"), F.substring(api_key, 1, 8), F.lit("..."))).otherwise(address)
    if kind == "combined":
        return F.concat(address, F.lit(":"), F.coalesce(session, F.lit("no_session")))
    return address


class Bucket:
    """Token bucket with a slower burst reserve; time in seconds, requests in order."""

    def __init__(self, per_minute: float, burst: float, tokens: float | None = None, reserve: float | None = None, last: float | None = None) -> None:
        self.per_minute, self.burst = per_minute, burst
        self.tokens = per_minute if tokens is None else tokens
        self.reserve = burst if reserve is None else reserve
        self.last = last

    def take(self, now: float, weight: float = 1.0) -> str:
        """allowed, burst or rejected."""
        passed = 0.0 if self.last is None else max(0.0, now - self.last)
        self.last = now
        self.tokens = min(self.per_minute, self.tokens + passed * self.per_minute / 60)
        self.reserve = min(self.burst, self.reserve + passed * self.burst / 600)
        if self.tokens >= weight:
            self.tokens -= weight
            return "allowed"
        if self.reserve >= weight:
            self.reserve -= weight
            return "burst"
        return "rejected"


def exempt(path: Column, prefixes: tuple[str, ...] = EXEMPT) -> Column:
    """Paths that no limit applies to."""
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes])


def rate_limited(events: DataFrame, client: str, ts: str, event: str, per_minute: float, burst: float) -> DataFrame:
    """(client, event, decision, tokens, reserve) of a stored log: the batch form of the streaming limiter.

    A client's requests are streamed in time order through one bucket; memory holds one Arrow batch.
    """
    kind = events.schema[client].dataType.simpleString()
    rows = events.select(
        F.col(client).alias("client"), F.col(event).cast("long").alias("event"), F.unix_micros(
            F.col(ts).cast("timestamp")
        ).alias("us"), F.lit(float(per_minute)).alias("per_minute"), F.lit(float(burst)).alias("burst")
    )
    return _through_buckets(rows, kind).drop("per_minute")


def _through_buckets(rows: DataFrame, kind: str) -> DataFrame:
    """(client, event, decision, tokens, reserve, per_minute) for (client, event, us, per_minute, burst); a bucket a client."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bucket = None, None
        for part in parts:
            out = []
            for who, us, per_minute, burst in zip(part["client"], part["us"], part["per_minute"], part["burst"], strict=True):
                if bucket is None or who != now:
                    now, bucket = who, Bucket(per_minute, burst)
                out.append((bucket.take(us / 1e6), round(bucket.tokens, 6), round(bucket.reserve, 6)))
            yield pd.DataFrame(
                {
                    "client": part["client"], "event": part["event"], "decision": [o[0] for o in out], "tokens": [o[1] for o in out],
                    "reserve": [o[2] for o in out], "per_minute": part["per_minute"],
                }
            )

    schema = f"client {kind}, event long, decision string, tokens double, reserve double, per_minute double"
    return rows.repartition("client").sortWithinPartitions("client", "us", "event").mapInPandas(run, schema)


def recent_requests(events: DataFrame, client: str, ts: str, seconds: int = 60) -> DataFrame:
    """Each request with the client's number of requests in the window that ends with it."""
    w = Window.partitionBy(client).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w))
