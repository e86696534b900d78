"""The store of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import state
from siltstream.plans.crawl_queries import ADMISSIBLE, NETLOC
from siltstream.plans.registry import query
from siltstream.sources.tables import table

LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(last_try, discovered_at) DESC NULLS LAST,
    status DESC NULLS LAST, type DESC NULLS LAST, retries DESC NULLS LAST, last_error DESC NULLS LAST, last_try DESC NULLS LAST, discovered_at DESC NULLS LAST) AS rn FROM urls) WHERE rn = 1)"""
MICROS = "epoch_us({0})"


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """One row an address: its latest state."""
    return state.latest(table(spark, folder, "urls"), "url", F.coalesce("last_try", "discovered_at"))


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query(f"WITH {LATEST} SELECT url, status, type, retries, last_error, {MICROS.format('last_try')} AS tried, {MICROS.format('discovered_at')} AS discovered FROM latest")
def state_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).select("url", "status", "type", "retries", "last_error", _micros("last_try").alias("tried"), _micros("discovered_at").alias("discovered"))


@query("""SELECT url, status, coalesce(retries, 0) AS retries FROM urls WHERE type = 'webpage' AND (status = 'pending' OR (status = 'failed' AND coalesce(retries, 0) < 3))""")
def pending_scan(spark: SparkSession, folder: str) -> DataFrame:
    return state.pending(table(spark, folder, "urls"), "webpage").select("url", "status", F.coalesce("retries", F.lit(0)).alias("retries"))


@query(f"""WITH {LATEST}, fresh AS (SELECT url, min(item_id) AS first_item FROM scraped_items WHERE {ADMISSIBLE.format("(url || '?print=1')")} GROUP BY url),
    after AS (SELECT url, status, type FROM latest UNION ALL SELECT url || '?print=1', 'pending', 'webpage' FROM fresh WHERE url || '?print=1' NOT IN (SELECT url FROM latest WHERE url IS NOT NULL))
    SELECT {NETLOC.format('url')} AS host, status, count(*) AS urls FROM after GROUP BY ALL""")
def state_insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """The print views of all delivered pages, inserted where the store lacks them."""
    items = table(spark, folder, "scraped_items", "item_id", "url")
    new = items.select(F.concat("url", F.lit("?print=1")).alias("url"), F.lit("pending").alias("status"), F.lit("webpage").alias("type"), "item_id")
    after, _ = state.insert_ignore(_store(spark, folder), new, F.col("item_id"))
    return after.groupBy(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1).alias("host"), "status").agg(F.count("*").alias("urls"))


CHANGES = """changes AS (SELECT url, CASE WHEN content IS NULL OR trim(content) = '' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN content IS NULL OR trim(content) = '' THEN repeat('content is empty; ', 40) END AS error, extracted_at AS moment, item_id AS seq FROM scraped_items),
    last AS (SELECT url, arg_max(status, seq) AS status, max_by(struct_pack(e := error), seq).e AS error, max_by(struct_pack(a := moment), seq).a AS moment FROM changes GROUP BY url)"""


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "url", "content", "extracted_at")
    blank = F.col("content").isNull() | (F.trim("content") == "")
    return items.select("url", F.when(blank, "failed").otherwise("completed").alias("status"), F.when(blank, F.lit("content is empty; " * 40)).alias("error"), F.col("extracted_at").alias("at"), F.col("item_id").alias("seq"))


@query(f"""WITH {LATEST}, {CHANGES} SELECT s.url, coalesce(l.status, s.status) AS status, CASE WHEN l.url IS NULL THEN s.last_error ELSE left(l.error, 500) END AS last_error,
    {MICROS.format('CASE WHEN l.url IS NULL THEN s.last_try ELSE l.moment END')} AS tried FROM latest s LEFT JOIN last l ON s.url = l.url""")
def state_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries applied to the store in order: the last of an address wins, and success clears its error."""
    merged = state.merge_status(_store(spark, folder), _changes(spark, folder))
    return merged.select("url", "status", "last_error", _micros("last_try").alias("tried"))


@query(f"""WITH {LATEST}, more AS (SELECT url, count(*) AS n FROM scraped_items WHERE content IS NULL OR trim(content) = '' GROUP BY url)
    SELECT coalesce(l.retries, 0) + coalesce(m.n, 0) AS retries, count(*) AS urls FROM latest l LEFT JOIN more m ON l.url = m.url GROUP BY 1""")
def state_retry(spark: SparkSession, folder: str) -> DataFrame:
    failed = _changes(spark, folder).filter("status = 'failed'").select("url")
    return state.add_retries(_store(spark, folder), failed).groupBy("retries").agg(F.count("*").alias("urls"))


@query(f"""WITH {LATEST} SELECT url, coalesce(retries, 0) + 1 AS attempt, coalesce(retries, 0) + 1 < 3 AS again,
    CASE WHEN coalesce(retries, 0) + 1 < 3 THEN {MICROS.format('last_try')} + CAST(pow(2, coalesce(retries, 0) + 1) AS BIGINT) * 1000000 END AS next_try FROM latest WHERE status = 'failed'""")
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return state.next_tries(_store(spark, folder).filter("status = 'failed'")).select("url", "attempt", "again", _micros("next_try").alias("next_try"))


@query(f"""SELECT count(*) AS kept, count(*) FILTER (status = 'completed') AS completed FROM urls WHERE {NETLOC.format('url')} <> 'meridianwire.example'""")
def state_reset_domain(spark: SparkSession, folder: str) -> DataFrame:
    kept = state.reset_domain(table(spark, folder, "urls"), "meridianwire.example")
    return kept.agg(F.count("*").alias("kept"), F.count_if(F.col("status") == "completed").alias("completed"))
