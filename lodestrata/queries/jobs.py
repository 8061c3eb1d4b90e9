"""Job states, tiers, builder statistics: queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import activity as A
from lodestrata.queries.registry import query
from lodestrata.sources.tables import table

def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_TIER = "CASE user_id % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'premium' WHEN 2 THEN 'gold' WHEN 3 THEN 'enterprise' END"


def _tier():
    n = F.col("user_id") % 5
    return F.when(n == 0, "free").when(n == 1, "premium").when(n == 2, "gold").when(n == 3, "enterprise")


@query(
    f"SELECT event_id, tier, CASE tier WHEN 'premium' THEN 300.0 WHEN 'enterprise' THEN 1000.0 ELSE 60.0 END AS per_minute, CASE tier WHEN 'premium' THEN 30.0 WHEN 'enterprise' THEN 100.0 ELSE 5.0 END AS burst FROM (SELECT event_id, {_TIER} AS tier FROM events)"
)
def r6_tier_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Each request with its tier's limits; unknown tiers and requests without one take the default tier's."""
    e = table(spark, folder, "events").select("event_id", _tier().alias("tier"))
    return e.withColumn("l", A.tier_limits(F.col("tier"))).select("event_id", "tier", "l.per_minute", "l.burst")


@query(
    "WITH s AS (SELECT user_id, event_id, CASE WHEN value < 2 THEN 'failed' WHEN value > 198 THEN 'completed' WHEN value > 20 THEN 'processing' ELSE 'queued' END AS state, epoch_us(ts) AS us FROM events) "
    "SELECT user_id, coalesce(arg_min(state, row(us, event_id)) FILTER (state IN ('completed', 'failed')), arg_max(state, row(us, event_id))) AS state, count(*) AS n_events FROM s GROUP BY user_id"
)
def r9_job_states(spark: SparkSession, folder: str) -> DataFrame:
    """A job's state from its events, in the order of their times."""
    v = F.col("value")
    state = F.when(v < 2, "failed").when(v > 198, "completed").when(v > 20, "processing").otherwise("queued")
    return A.job_states(_events(spark, folder).withColumn("state", state), "user_id", "state", ["us", "event_id"])


@query(
    "SELECT event_type, count(*) AS n_chunks, CAST(sum(user_id) AS BIGINT) AS n_candidates, round(avg(value), 6) AS avg_score, round(coalesce(count(*) FILTER (value > 100) / nullif(count(*), 0), 0), 6) AS success_rate, "
    "round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS per_second FROM events GROUP BY event_type"
)
def a6_builder_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return A.builder_statistics(_events(spark, folder), "event_type", "user_id", "value", F.col("value") > 100, "us")


@query("SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'Unknown error' ELSE 'code ' || event_id END AS error FROM events WHERE value < 2")
def a13_failures(spark: SparkSession, folder: str) -> DataFrame:
    error = F.when(F.col("event_id") % 2 != 0, F.concat(F.lit("code "), F.col("event_id")))
    return A.failures(table(spark, folder, "events"), ["user_id", "event_type"], F.col("value") < 2, error)


@query(
    "SELECT count(*) AS n_total, count(*) FILTER (value > 20) AS n_ok, count(*) FILTER (value <= 20) AS n_failed, round(100 * count(*) FILTER (value > "
    "20) / count(*), 2) AS percent_ok FROM events"
)
def a15_batch_totals(spark: SparkSession, folder: str) -> DataFrame:
    return A.batch_totals(table(spark, folder, "events"), F.col("value") > 20)


#: The log runs a thousand times faster here, so that a minute holds requests.
@query(
    "SELECT user_id, count(*) FILTER (epoch_us(ts) // 1000 >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 60000000) AS recent, count(*) AS n FROM "
    "events GROUP BY user_id"
)
def a18_client_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of each client in the last minute of the log, and all."""
    e = _events(spark, folder).select("user_id", F.floor(F.col("us") / 1000).alias("us"))
    now = F.lit(e.agg(F.max("us")).first()[0]).cast("long")
    return A.client_statistics(e, "user_id", "us", now)


@query(
    "SELECT event_type, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) "
    "AS n FROM events GROUP BY event_type"
)
def a19_cache_hit_rates(spark: SparkSession, folder: str) -> DataFrame:
    return A.hit_rates(table(spark, folder, "events"), "event_type", F.get_json_object("props", "$.k").cast("long") % 2 == 0)


@query("SELECT user_id, max(epoch_us(ts)) AS updated FROM events GROUP BY user_id ORDER BY updated DESC, user_id LIMIT 25")
def t11_newest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Top-k report: the 25 jobs with the newest events."""
    return _events(spark, folder).groupBy("user_id").agg(F.max("us").alias("updated")).orderBy(F.desc("updated"), "user_id").limit(25)


_SPOKEN = """seg AS (SELECT user_id, event_type, (epoch_us(ts) % 2592000000000) / 1e6 AS s0, (epoch_us(ts) % 2592000000000) / 1e6 + value * 100 AS s1 FROM events),
p AS (SELECT *, CASE WHEN s0 - lag(s1, 1, 0.0) OVER (PARTITION BY user_id ORDER BY s0) > 2.0 THEN 1 ELSE 0 END AS pause FROM seg),
sp AS (SELECT *, CAST(sum(pause) OVER (PARTITION BY user_id ORDER BY s0 ROWS UNBOUNDED PRECEDING) % 2 + 1 AS INTEGER) AS speaker FROM p),
ch AS (SELECT *, coalesce(lag(speaker) OVER (PARTITION BY user_id ORDER BY s0) <> speaker, true) AS fresh, CAST(floor(s0) AS BIGINT) AS s FROM sp),
ln AS (SELECT user_id, s0, s1, CASE WHEN fresh THEN chr(10) || '**Speaker ' || speaker || ':**' || chr(10) || chr(10) ELSE '' END || printf('[%02d:%02d:%02d] ', s // 3600, s % 3600 // 60, s % 60) || event_type AS line FROM ch),
one AS (SELECT user_id, CAST(floor(arg_max(s1, s0)) AS BIGINT) AS d, string_agg(line, chr(10) ORDER BY s0) AS body FROM ln GROUP BY user_id)"""


@query(
    f"WITH {
        _SPOKEN
    } SELECT user_id, '# Audio Transcription: ' || user_id || chr(10) || chr(10) || '**Duration:** ' || CASE WHEN d >= 3600 THEN printf('%dh %dm %ds', d // 3600, d % 3600 // 60, d % 60) WHEN d >= 60 THEN printf('%dm %ds', d // 60, d % 60) ELSE printf('%ds', d) END "
    "|| chr(10) || '**Language:** en' || chr(10) || '**Model:** whisper' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body AS markdown FROM one"
)
def f32_event_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    start = (F.col("us") % 2_592_000_000_000) / 1e6
    segments = _events(spark, folder).select("user_id", "event_type", start.alias("s0"), (start + F.col("value") * 100).alias("s1"))
    return A.transcripts(segments, "user_id", "s0", "s1", "event_type")


@query(
    "SELECT event_type AS phase, CAST(user_id AS VARCHAR) AS file, coalesce(arg_max('code ' || json_extract_string(props, '$.k'), event_id) FILTER (event_id % 3 <> 0), 'Unknown error') AS error "
    "FROM events WHERE value < 5 GROUP BY ALL"
)
def a12_failure_report(spark: SparkSession, folder: str) -> DataFrame:
    """The last error of each file; a third of the failures say nothing."""
    error = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("code "), F.get_json_object("props", "$.k")))
    return A.failure_report(table(spark, folder, "events").filter("value < 5"), "event_type", "user_id", error, ["event_id"])


#: Requests of ten clients from the log, a hundred thousand times faster; addresses, tiers, kinds and paths by number.
_REQUESTS = f"""req AS (SELECT event_id AS request, epoch_us(ts) // 100000 AS us, 'c' || user_id % 10 AS client, '10.0.0.' || user_id % 40 AS ip, {_TIER} AS tier,
  CASE user_id % 3 WHEN 0 THEN 'ip_based' WHEN 1 THEN 'api_key_based' END AS client_type, CASE WHEN event_id % 11 = 0 THEN '/health/live' ELSE '/api/health' END AS path FROM events),
lim AS (SELECT *, CASE WHEN tier IN ('free', 'premium', 'enterprise') THEN 'tier:' || tier WHEN tier IS NULL THEN 'tier:free' WHEN client_type IS NOT NULL THEN 'type:' || client_type ELSE 'fallback' END AS limiter,
  CASE WHEN path LIKE '/health%' THEN 'exempt' WHEN ip = '10.0.0.7' THEN 'blocked' END AS pass FROM req),
sized AS (SELECT *, CASE limiter WHEN 'tier:free' THEN 60.0 WHEN 'tier:premium' THEN 300.0 WHEN 'tier:enterprise' THEN 1000.0 WHEN 'type:ip_based' THEN 100.0 WHEN 'type:api_key_based' THEN 500.0 ELSE 100.0 END::DOUBLE AS pm,
  CASE limiter WHEN 'tier:free' THEN 5.0 WHEN 'tier:premium' THEN 30.0 WHEN 'tier:enterprise' THEN 100.0 WHEN 'type:ip_based' THEN 10.0 WHEN 'type:api_key_based' THEN 50.0 ELSE 10.0 END::DOUBLE AS bu FROM lim)"""


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("user_id")
    return _events(spark, folder).select(
        F.col("event_id").alias("request"), F.timestamp_micros(
            F.floor(F.col("us") / 100_000)
        ).alias("ts"), F.concat(F.lit("c"), u % 10).alias("client"), F.concat(F.lit("10.0.0."), u % 40).alias("ip"),
        _tier().alias("tier"), F.when(u % 3 == 0, "ip_based").when(u % 3 == 1, "api_key_based").alias("client_type"), F.when(F.col("event_id") % 11 == 0, "/health/live").otherwise("/api/health").alias("path"),
    )


@query(f"WITH {_REQUESTS} SELECT request, limiter, pm AS per_minute, bu AS burst, pass IS NOT NULL AND pass = 'exempt' AS is_exempt FROM sized")
def r7_limiter_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Which limiter decides: that of the tier, else of the kind of client, else the fallback."""
    r = _requests(spark, folder).withColumn("l", A.limiter(F.col("tier"), F.col("client_type")))
    return r.select("request", "l.limiter", "l.per_minute", "l.burst", A.exempt(F.col("path")).alias("is_exempt"))


@query(
    f"""WITH RECURSIVE {_REQUESTS}, seq AS (SELECT request, limiter || '|' || client AS who, us, us::DOUBLE / 1e6 AS t, pm, bu, row_number() OVER (PARTITION BY limiter, client ORDER BY us, request) AS n FROM sized WHERE pass IS NULL),
r AS (SELECT request, who, n, t, pm, bu, pm - 1 AS tok, bu AS res, 'allowed' AS decision FROM seq WHERE n = 1
  UNION ALL SELECT request, who, n, t, pm, bu, CASE WHEN f >= 1 THEN f - 1 ELSE f END, CASE WHEN f < 1 AND g >= 1 THEN g - 1 ELSE g END, CASE WHEN f >= 1 THEN 'allowed' WHEN g >= 1 THEN 'burst' ELSE 'rejected' END
  FROM (SELECT s.request, s.who, s.n, s.t, s.pm, s.bu, least(s.pm, r.tok + greatest(0.0, s.t - r.t) * s.pm / 60) AS f, least(s.bu, r.res + greatest(0.0, s.t - r.t) * s.bu / 600) AS g FROM r JOIN seq s ON s.who = r.who AND s.n = r.n + 1)),
head AS (SELECT request, decision, CAST(pm AS INTEGER) AS "limit", CAST(floor(round(tok, 6)) + floor(round(res, 6)) AS INTEGER) AS remaining, CASE WHEN round(tok, 6) >= pm THEN 0.0 ELSE (pm - round(tok, 6)) / (pm / 60) END AS reset FROM r)
SELECT request, decision, "limit", remaining, round(reset, 6) AS reset, CASE WHEN decision = 'rejected' THEN greatest(1, CAST(floor(reset) AS INTEGER)) WHEN remaining <= 0 THEN CAST(floor(reset) AS INTEGER) END AS retry_after FROM head
UNION ALL SELECT request, pass, NULL, NULL, NULL, NULL FROM sized WHERE pass IS NOT NULL"""
)
def r8_limited_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain with its headers: exempt paths, addresses, limiter, bucket."""
    return A.limited_requests(_requests(spark, folder), ["10.0.0.7"], [])


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events")
def w12_rank_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"),
    )
