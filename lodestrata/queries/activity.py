"""Request logs, jobs, progress, speakers, limits: queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text, vectors
from lodestrata.operators import activity as A
from lodestrata.queries.registry import query
from lodestrata.sources.tables import table

BASE = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with microseconds since 1970; the stored clock has no zone."""
    e = table(spark, folder, "events")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_clients, round(avg(value), 6) AS avg_value, round(sum(value), 4) AS total FROM "
    "events GROUP BY event_type"
)
def a17_request_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_clients"), F.round(F.avg("value"), 6).alias("avg_value"),
        F.round(F.sum("value"), 4).alias("total"),
    )


@query(f"WITH {BASE} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM e")
def r5_recent_requests(spark: SparkSession, folder: str) -> DataFrame:
    return A.recent_requests(_events(spark, folder), "user_id", "ts", 86_400).select("event_id", "recent")


@query(f"WITH {BASE} SELECT user_id, us // 3600000000 AS hour, count(*) AS n, round(max(value), 6) AS top FROM e GROUP BY ALL")
def r5_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


SESSION = f"WITH {
    BASE
}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 43200000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM g) SELECT user_id, min(us) AS started, count(*) AS n FROM s GROUP BY user_id, k"


@query(SESSION)
def r4_user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("at", F.timestamp_micros("us"))
    found = e.groupBy("user_id", F.session_window("at", "12 hours").alias("w")).agg(F.min("us").alias("started"), F.count("*").alias("n"))
    return found.select("user_id", "started", "n")


@query(
    f"""WITH RECURSIVE {BASE}, seq AS (SELECT event_id, user_id, us::DOUBLE / 1e6 AS t, (1.0::DOUBLE / 720) AS pm, 2.0::DOUBLE AS bu, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e),
r AS (SELECT event_id, user_id, n, t, 'burst' AS decision, pm AS tok, bu - 1 AS res FROM seq WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, t, CASE WHEN f >= 1 THEN 'allowed' WHEN g >= 1 THEN 'burst' ELSE 'rejected' END, CASE WHEN f >= 1 THEN f - 1 ELSE f END, CASE WHEN f < 1 AND g >= 1 THEN g - 1 ELSE g END
  FROM (SELECT s.event_id, s.user_id, s.n, s.t, least(s.pm, r.tok + greatest(0.0, s.t - r.t) * s.pm / 60) AS f, least(s.bu, r.res + greatest(0.0, s.t - r.t) * s.bu / 600) AS g FROM r JOIN seq s ON s.user_id = r.user_id AND s.n = r.n + 1))
SELECT user_id AS client, event_id AS event, decision, round(tok, 6) AS tokens, round(res, 6) AS reserve FROM r"""
)
def r1_rate_limited(spark: SparkSession, folder: str) -> DataFrame:
    return A.rate_limited(_events(spark, folder), "user_id", "ts", "event_id", per_minute=1.0 / 720, burst=2)


@query(f"WITH {BASE} SELECT user_id, event_type, arg_max(value, row(us, event_id)) AS status, count(*) AS n_events FROM e GROUP BY ALL")
def r10_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    return A.latest_status(_events(spark, folder), ["user_id", "event_type"], "value", ["us", "event_id"])


@query(
    "SELECT user_id, CASE WHEN bool_and(value > 1) THEN 'completed' ELSE 'failed' END AS status, count(*) FILTER (value > 1) AS succeeded, count(*) AS "
    "n_files FROM events GROUP BY user_id"
)
def a14_job_status(spark: SparkSession, folder: str) -> DataFrame:
    return A.job_status(table(spark, folder, "events"), "user_id", F.col("value") > 1)


@query(
    "SELECT event_type, user_id % 10 AS shard, count(*) AS n, count(*) FILTER (value < 20) AS n_failed, round(count(*) FILTER (value < 20) / count(*), "
    "6) AS failure_rate, count(*) >= 10 AND count(*) FILTER (value < 20) / count(*) > 0.1 AS alert FROM events GROUP BY ALL"
)
def a7_failure_rates(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("shard", F.col("user_id") % 10)
    return A.failure_rates(e, ["event_type", "shard"], F.col("value") < 20)


@query(
    "SELECT coalesce(event_type, 'total') AS event_type, count(*) AS n_total, count(*) FILTER (value >= 20) AS n_completed, count(*) FILTER (value < "
    "20) AS n_failed FROM events GROUP BY ROLLUP (event_type)"
)
def a11_phase_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("state", F.when(F.col("value") < 20, "failed").otherwise("completed"))
    return A.phase_summary(e.select("event_type", "state"), "event_type", "state")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f66_json_property(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


SEGMENTS = f"{BASE}, seg AS (SELECT event_id, user_id, (us % 2592000000000) / 1e6 AS s0, (us % 2592000000000) / 1e6 + value * 100 AS s1 FROM e)"


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    start = (F.col("us") % 2_592_000_000_000) / 1e6
    return _events(spark, folder).select("event_id", "user_id", start.alias("s0"), (start + F.col("value") * 100).alias("s1"))


@query(f"WITH {SEGMENTS}, p AS (SELECT *, CASE WHEN s0 - lag(s1, 1, 0.0) OVER (PARTITION BY user_id ORDER BY s0) > 20000 THEN 1 ELSE 0 END AS pause FROM seg) SELECT event_id, CAST(sum(pause) OVER (PARTITION BY user_id ORDER BY s0 ROWS UNBOUNDED PRECEDING) % 2 + 1 AS INTEGER) AS speaker FROM p")
def w8_speakers(spark: SparkSession, folder: str) -> DataFrame:
    return A.speakers(_segments(spark, folder), "user_id", "s0", "s1", 20_000).select("event_id", "speaker")


@query(f"WITH {SEGMENTS} SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(s0) AS BIGINT) // 3600, CAST(floor(s0) AS BIGINT) % 3600 // 60, CAST(floor(s0) AS BIGINT) % 60) AS clock, printf('%d:%02d', CAST(floor(s0) AS BIGINT) // 60, CAST(floor(s0) AS BIGINT) % 60) AS short FROM seg")
def f31_clocks(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).select("event_id", text.clock(F.col("s0")).alias("clock"), text.short_clock(F.col("s0")).alias("short"))


@query(f"WITH {SEGMENTS} SELECT user_id, round(arg_max(s1, s0), 6) AS duration FROM seg GROUP BY user_id")
def f63_durations(spark: SparkSession, folder: str) -> DataFrame:
    return A.recording_durations(_segments(spark, folder), "user_id", "s0", "s1")


SHOTS = "shots AS (SELECT user_id, event_id AS shot, s0 AS a, lead(s0) OVER (PARTITION BY user_id ORDER BY s0) AS b FROM seg)"


@query(f"WITH {SEGMENTS}, {SHOTS}, m AS (SELECT DISTINCT user_id, s1 AS t FROM seg), l AS (SELECT user_id, arg_max(shot, a) AS last_shot FROM shots GROUP BY user_id) SELECT m.user_id, round(m.t, 6) AS t, coalesce((SELECT min(shot) FROM shots s WHERE s.user_id = m.user_id AND s.a <= m.t AND m.t < s.b), last_shot) AS shot FROM m JOIN l USING (user_id)")
def j15_shots_at_moments(spark: SparkSession, folder: str) -> DataFrame:
    seg = _segments(spark, folder)
    shots = seg.select("user_id", F.col("event_id").alias("shot"), F.col("s0").alias("a"), F.lead("s0").over(Window.partitionBy("user_id").orderBy("s0")).alias("b"))
    moments = seg.select("user_id", F.col("s1").alias("t")).distinct()
    return A.at_moment(moments, shots, "user_id", "t", "a", "b").select("user_id", F.round("t", 6).alias("t"), "shot")


@query(
    "SELECT event_id, CASE WHEN 'u' || user_id IN ('u1', 'u2') THEN 'blocked' WHEN 'u' || user_id IN ('u2', 'u3', 'u4') THEN 'whitelisted' ELSE "
    "'blocked' END AS access FROM events"
)
def p18_ip_access(spark: SparkSession, folder: str) -> DataFrame:
    ip = F.concat(F.lit("u"), F.col("user_id"))
    return table(spark, folder, "events").select("event_id", A.ip_access(ip, ["u1", "u2"], ["u2", "u3", "u4"]).alias("access"))


@query(
    "SELECT event_id, '10.0.0.' || user_id AS by_address, 'session:s' || user_id AS by_session, 'api_key:' || substr('key' || event_id || 'abcdefgh', "
    "1, 8) || '...' AS by_key FROM events"
)
def f28_client_ids(spark: SparkSession, folder: str) -> DataFrame:
    u, n = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    parts = (F.lit("9.9.9.9"), F.concat(F.lit("10.0.0."), u, F.lit(", 1.1.1.1")), F.concat(F.lit("s"), u), F.concat(F.lit("key"), n, F.lit("abcdefgh")))
    return table(spark, folder, "events").select(
        "event_id",
        *[A.client_id(*parts, kind).alias(name) for kind, name in (("ip", "by_address"), ("session", "by_session"), ("api_key", "by_key"))],
    )


@query("SELECT event_id, CASE WHEN value >= 100 THEN 0.0 ELSE round((100 - value) / (100 / 60), 6) END AS reset, round(least(100.0, value + 30 * (100.0 / 60)), 6) AS refilled, round(least(30.0, pow(2.0, event_id % 8)), 6) AS wait FROM events".replace("(100 / 60)", "(100.0 / 60)"))
def f61_limits(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        "event_id", F.round(vectors.reset_seconds(F.col("value"), 100), 6).alias("reset"),
        F.round(vectors.refilled(F.col("value"), F.lit(30), 100), 6).alias("refilled"),
        F.round(vectors.backoff(F.col("event_id") % 8), 6).alias("wait"),
    )


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 25)), 6) AS p FROM events")
def f41_sigmoids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.round(vectors.sigmoid((F.col("value") - 50) / 25), 6).alias("p"))


@query(
    "WITH f AS (SELECT DISTINCT user_id FROM events), c AS (SELECT DISTINCT user_id FROM events WHERE value > 199), x AS (SELECT DISTINCT user_id FROM "
    "events WHERE value < 0.2) SELECT user_id, user_id IN (SELECT user_id FROM x) AS is_failed FROM f WHERE user_id NOT IN (SELECT user_id FROM c)"
)
def j16_pending_files(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return A.pending(e.select("user_id").distinct(), e.filter("value > 199"), e.filter("value < 0.2"), "user_id", "user_id").select("user_id", "is_failed")


@query(f"WITH {BASE} SELECT user_id, event_type, min(us) AS started, max(us) AS ended, round((max(us) - min(us)) / 1e6, 6) AS seconds FROM e GROUP BY ALL")
def w13_stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    return A.stage_durations(_events(spark, folder), ["user_id", "event_type"], "us")


_ERRORS = (
    "DatabaseError", "ConnectionError", "MemoryError", "SystemError", "OSError", "TimeoutError", "LLMCommandError", "ToolExecutionError", "ValidationError", "ConfigurationError",
    "RateLimitExceededError", "IngestionError", "FileAccessError", "KeyError",
)
_STAGES = ("query_generation", "vector_search", "final_assembly", None)


@query(
    "WITH x AS (SELECT [" + ", ".join(repr(x) for x in _ERRORS) + "][event_id % 14 + 1] AS error, CASE user_id % 4 WHEN 0 THEN 'query_generation' WHEN 1 THEN 'vector_search' WHEN 2 THEN 'final_assembly' END AS stage FROM events) "
    "SELECT error, stage, CASE WHEN error IN ('DatabaseError', 'ConnectionError', 'MemoryError', 'SystemError', 'OSError') THEN 'critical' "
    "WHEN error IN ('TimeoutError', 'LLMCommandError', 'ToolExecutionError', 'ValidationError', 'ConfigurationError') OR stage = 'query_generation' OR stage = 'final_assembly' THEN 'high' "
    "WHEN error IN ('RateLimitExceededError', 'IngestionError', 'FileAccessError') THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM x GROUP BY ALL"
)
def m22_severities(spark: SparkSession, folder: str) -> DataFrame:
    error = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 14 + 1).cast("int"))
    stage = F.element_at(F.array(*[F.lit(x).cast("string") for x in _STAGES]), (F.col("user_id") % 4 + 1).cast("int"))
    e = table(spark, folder, "events").select(error.alias("error"), stage.alias("stage"))
    return e.groupBy("error", "stage", A.severity(F.col("error"), F.col("stage")).alias("severity")).agg(F.count("*").alias("n"))
