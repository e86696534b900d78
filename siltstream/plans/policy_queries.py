"""Circuit breaker, throttle, seen set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators.policies import Breaker, Throttle, fold
from siltstream.plans.registry import query
from siltstream.sources.tables import table


def _breaker_sql(policy: Breaker) -> str:
    """The fold as a recursion over each site's events in order."""
    n, wait = policy.threshold, policy.timeout
    # Before an event: expired blocks are lifted. NULL until = not blocked.
    failures = "CASE WHEN s.until IS NOT NULL AND e.moment >= s.until THEN 0 ELSE s.failures END"
    blocked = "s.until IS NOT NULL AND e.moment < s.until"
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT lower(domain) AS site, epoch_us(ts) AS moment, ok, row_number() OVER (PARTITION BY lower(domain) ORDER BY ts, ok NULLS FIRST) AS rn FROM breaker_events WHERE ts IS NOT NULL),
        f AS (
            SELECT site, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS BOOLEAN) AS ok, CAST(0 AS BIGINT) AS rn, 0 AS failures, CAST(NULL AS BIGINT) AS until, true AS allowed FROM (SELECT DISTINCT site FROM e)
            UNION ALL
            SELECT e.site, e.moment, e.ok, e.rn,
                CASE WHEN {blocked} THEN s.failures WHEN e.ok IS NULL THEN {failures} WHEN e.ok THEN 0 ELSE {failures} + 1 END,
                CASE WHEN {blocked} THEN s.until WHEN e.ok = false AND {failures} + 1 >= {n} THEN e.moment + {wait} END,
                NOT ({blocked})
            FROM f s JOIN e ON e.site IS NOT DISTINCT FROM s.site AND e.rn = s.rn + 1)
        SELECT site, moment, ok, allowed, CASE WHEN until IS NULL THEN 'closed' ELSE 'open' END AS state, failures FROM f WHERE rn > 0"""


def _breaker(spark: SparkSession, folder: str, policy: Breaker) -> DataFrame:
    events = table(spark, folder, "breaker_events", "domain", "ts", "ok").select(F.lower("domain").alias("site"), "ts", "ok")
    out = fold(events, policy, "site", "ts", "ok")
    return out.filter("ts IS NOT NULL").select("site", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "ok", "allowed", "state", "failures")


ENGINE, TRANSPORT, SLOW = Breaker(5, 300_000_000), Breaker(5, 60_000_000), Breaker(2, 86_400_000_000)


@query(_breaker_sql(ENGINE))
def circuit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    return _breaker(spark, folder, ENGINE)


@query(_breaker_sql(TRANSPORT))
def circuit_breaker_transport(spark: SparkSession, folder: str) -> DataFrame:
    return _breaker(spark, folder, TRANSPORT)


@query(_breaker_sql(SLOW))
def circuit_breaker_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Two failures close a site for a day: a setting under which these sparse events do block."""
    return _breaker(spark, folder, SLOW)


def _throttle_sql(source: str, key: str, at: str, interval: int) -> str:
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT {key} AS key, epoch_us({at}) AS moment, row_number() OVER (PARTITION BY {key} ORDER BY {at}) AS rn FROM {source} WHERE {at} IS NOT NULL),
        f AS (
            SELECT key, moment, rn, moment AS last, true AS kept FROM e WHERE rn = 1
            UNION ALL
            SELECT e.key, e.moment, e.rn, CASE WHEN e.moment - f.last >= {interval} THEN e.moment ELSE f.last END, e.moment - f.last >= {interval} FROM f JOIN e ON e.key IS NOT DISTINCT FROM f.key AND e.rn = f.rn + 1)
        SELECT key, moment, kept FROM f"""


def _throttled(events: DataFrame, interval: int) -> DataFrame:
    out = fold(events, Throttle(interval), "key", "at")
    return out.filter("at IS NOT NULL").select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("moment"), "kept")


@query(_throttle_sql("breaker_events", "lower(domain)", "ts", 3_600_000_000))
def throttle(spark: SparkSession, folder: str) -> DataFrame:
    """At most one event a site and hour since the last one kept."""
    events = table(spark, folder, "breaker_events", "domain", "ts").select(F.lower("domain").alias("key"), F.col("ts").alias("at"))
    return _throttled(events, 3_600_000_000)


@query(f"""WITH t AS ({_throttle_sql("events", "event_type", "ts", 600_000_000)}) SELECT key, count(*) AS events, count(*) FILTER (kept) AS emitted,
    count(*) FILTER (NOT kept) AS throttled, round(count(*) FILTER (NOT kept) * 100.0 / count(*), 2) AS throttle_percent FROM t GROUP BY key""")
def throttle_stats(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "event_type", "ts").select(F.col("event_type").alias("key"), F.col("ts").alias("at"))
    counted = _throttled(events, 600_000_000).groupBy("key").agg(F.count("*").alias("events"), F.count_if("kept").alias("emitted"), F.count_if(~F.col("kept")).alias("throttled"))
    return counted.withColumn("throttle_percent", F.round(F.col("throttled") * 100.0 / F.col("events"), 2))


@query(_throttle_sql("scraped_items", "url", "extracted_at", 3_600_000_000))
def seen_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that a seen set with a time to live of an hour lets through."""
    items = table(spark, folder, "scraped_items", "url", "extracted_at").select(F.col("url").alias("key"), F.col("extracted_at").alias("at"))
    return _throttled(items, 3_600_000_000)
