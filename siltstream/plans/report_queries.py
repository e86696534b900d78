"""Mission reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions import text as X
from siltstream.operators import report
from siltstream.plans.registry import query
from siltstream.sources import sinks
from siltstream.sources.tables import table

SITE = "lower(domain)"


def _urls(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "urls", *columns)


@query("SELECT status, count(*) AS count FROM urls GROUP BY status")
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return report.status_histogram(_urls(spark, folder, "status"))


@query("SELECT CASE WHEN grouping(status) = 1 THEN 'TOTAL' ELSE coalesce(status, '(none)') END AS status, count(*) AS count FROM urls GROUP BY ROLLUP (status)")
def status_total(spark: SparkSession, folder: str) -> DataFrame:
    return report.status_totals(_urls(spark, folder, "status"))


@query("""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'skipped_robots') AS skipped_robots, count(*) FILTER (type = 'webpage') AS total_webpages, count(*) FILTER (type = 'asset') AS total_assets, count(*) AS total FROM urls""")
def stats_map(spark: SparkSession, folder: str) -> DataFrame:
    return report.stats_map(_urls(spark, folder, "status", "type"))


@query("SELECT coalesce(last_error, 'Unknown') AS error, count(*) AS count, last_error IS NULL AS missing FROM urls WHERE status = 'failed' GROUP BY last_error ORDER BY count DESC, error, missing LIMIT 5")
def top_errors(spark: SparkSession, folder: str) -> DataFrame:
    return report.top_errors(_urls(spark, folder, "status", "last_error"))


SEQ = "url || '|' || coalesce(CAST(epoch_us(last_try) AS VARCHAR), '') || '|' || last_error || '|' || coalesce(CAST(epoch_us(discovered_at) AS VARCHAR), '') || '|' || coalesce(CAST(retries AS VARCHAR), '')"
KIND = r"coalesce(nullif(regexp_extract(trim(last_error), '^([A-Za-z]+)', 1), ''), 'Unknown')"


@query(f"""SELECT type, count(*) AS count, min_by(message, seq) AS first_message, min_by(moment, seq) AS first_at, CAST(sum(coalesce(retries, 0)) AS BIGINT) AS retries, min(seq) AS first_seq
    FROM (SELECT {KIND} AS type, last_error AS message, epoch_us(discovered_at) AS moment, retries, {SEQ} AS seq FROM urls WHERE last_error IS NOT NULL) GROUP BY type""")
def errors_by_type(spark: SparkSession, folder: str) -> DataFrame:
    errors = _urls(spark, folder).filter("last_error IS NOT NULL")
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")).cast("string"), F.lit(""))
    seq = F.concat_ws("|", "url", micros("last_try"), "last_error", micros("discovered_at"), F.coalesce(F.col("retries").cast("string"), F.lit("")))
    kind = F.coalesce(F.nullif(F.regexp_extract(F.trim("last_error"), "^([A-Za-z]+)", 1), F.lit("")), F.lit("Unknown"))
    rows = errors.select(kind.alias("type"), F.col("last_error").alias("message"), F.unix_micros(F.col("discovered_at").cast("timestamp")).alias("at"), "retries", seq.alias("seq"))
    return report.errors_by_type(rows, "type", "message", "at", "retries", "seq")


@query(f"SELECT {KIND} AS type, count(*) AS count FROM urls WHERE last_error IS NOT NULL GROUP BY 1 ORDER BY 1")
def error_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    errors = _urls(spark, folder, "last_error").filter("last_error IS NOT NULL")
    kind = F.coalesce(F.nullif(F.regexp_extract(F.trim("last_error"), "^([A-Za-z]+)", 1), F.lit("")), F.lit("Unknown"))
    return errors.groupBy(kind.alias("type")).agg(F.count("*").alias("count")).orderBy("type")


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS running,
    count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status IN ('failed', 'skipped_robots')) AS failed FROM urls""")
def queue_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("status")
    return report.counters(_urls(spark, folder, "status"), total=F.lit(True), pending=s == "pending", running=s == "in_progress", done=s == "completed", failed=s.isin("failed", "skipped_robots"))


@query("SELECT url, status, type, count(*) AS n FROM urls WHERE status = 'failed' AND contains(lower(url), '/news/') GROUP BY ALL")
def queue_view(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder, "url", "status", "type").filter((F.col("status") == "failed") & F.lower("url").contains("/news/")).groupBy("url", "status", "type").agg(F.count("*").alias("n"))


LEVEL = "CASE WHEN status = 'failed' THEN 'ERROR' WHEN status = 'skipped_robots' THEN 'WARNING' ELSE 'INFO' END"


@query(f"SELECT count(*) FILTER (level = 'DEBUG') AS debug, count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'WARNING') AS warning, count(*) FILTER (level = 'ERROR') AS error FROM (SELECT {LEVEL} AS level FROM urls)")
def log_levels(spark: SparkSession, folder: str) -> DataFrame:
    level = F.when(F.col("status") == "failed", "ERROR").when(F.col("status") == "skipped_robots", "WARNING").otherwise("INFO")
    rows = _urls(spark, folder, "status").select(level.alias("level"))
    return report.counters(rows, **{x.lower(): F.col("level") == x for x in ("DEBUG", "INFO", "WARNING", "ERROR")})


@query("""SELECT item_id, level, message FROM (SELECT item_id, CASE WHEN content IS NULL OR trim(content) = '' THEN 'ERROR' ELSE 'INFO' END AS level,
    coalesce(nullif(title, ''), 'untitled') || ': ' || url AS message FROM (SELECT * FROM scraped_items ORDER BY item_id DESC LIMIT 500)) WHERE level = 'INFO'""")
def log_view(spark: SparkSession, folder: str) -> DataFrame:
    """The last 500 deliveries as log lines, filtered by level after the limit."""
    last = report.last_n(table(spark, folder, "scraped_items", "item_id", "title", "url", "content"), 500, "item_id")
    level = F.when(F.col("content").isNull() | (F.trim("content") == ""), "ERROR").otherwise("INFO")
    return last.select("item_id", level.alias("level"), F.concat(X.present("title", "untitled"), F.lit(": "), F.col("url")).alias("message")).filter("level = 'INFO'")


@query("SELECT item_id, url, title FROM scraped_items ORDER BY item_id DESC LIMIT 10")
def last_n(spark: SparkSession, folder: str) -> DataFrame:
    return report.last_n(table(spark, folder, "scraped_items", "item_id", "url", "title"), 10, "item_id")


@query("SELECT url, min(item_id) AS item_id FROM (SELECT url, item_id FROM scraped_items ORDER BY item_id DESC LIMIT 100) GROUP BY url")
def activity_first(spark: SparkSession, folder: str) -> DataFrame:
    last = report.last_n(table(spark, folder, "scraped_items", "url", "item_id"), 100, "item_id")
    return report.first_of_each(last, "url", "item_id")


@query(f"""SELECT {SITE} AS site, count(*) AS pages, count(*) FILTER (content IS NOT NULL AND trim(content) <> '') AS completed,
    round(count(*) FILTER (content IS NOT NULL AND trim(content) <> '') * 100.0 / count(*), 2) AS percent,
    CASE WHEN max(epoch_us(extracted_at)) > min(epoch_us(extracted_at)) THEN round(count(*) / ((max(epoch_us(extracted_at)) - min(epoch_us(extracted_at))) / 1e6 / 3600), 6) END AS pages_per_hour
    FROM scraped_items GROUP BY 1""")
def mission_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress and throughput by site."""
    items = table(spark, folder, "scraped_items", "domain", "content", "extracted_at")
    at, good = F.unix_micros(F.col("extracted_at").cast("timestamp")), F.coalesce(F.trim("content") != "", F.lit(False))
    counted = items.groupBy(F.lower("domain").alias("site")).agg(F.count("*").alias("pages"), F.count_if(good).alias("completed"), (F.max(at) - F.min(at)).alias("span"))
    hours = F.col("span") / F.lit(1e6) / F.lit(3600)
    return counted.select("site", "pages", "completed", X.ratio_percent("completed", "pages").alias("percent"), F.when(F.col("span") > 0, F.round(F.col("pages") / hours, 6)).alias("pages_per_hour"))


@query("SELECT count(*) AS requests, count(*) - count(DISTINCT md5(content || '|' || url)) AS hits, round((count(*) - count(DISTINCT md5(content || '|' || url))) * 100.0 / count(*), 2) AS hit_rate FROM scraped_items WHERE content IS NOT NULL AND url IS NOT NULL")
def cache_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How often a memo of extraction by content and address would have answered."""
    items = table(spark, folder, "scraped_items", "content", "url").filter("content IS NOT NULL AND url IS NOT NULL")
    keys = items.groupBy(F.md5(F.concat("content", F.lit("|"), "url")).alias("k")).agg(F.count("*").alias("n"))
    counted = keys.agg(F.sum("n").alias("requests"), (F.sum("n") - F.count("*")).alias("hits"))
    return counted.withColumn("hit_rate", X.ratio_percent("hits", "requests"))


SERIES = f"series AS (SELECT {SITE} AS site, epoch_us(date_trunc('hour', ts)) // 1000000 AS moment, count(*) AS n FROM breaker_events GROUP BY ALL)"


def _series(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "breaker_events").withColumn("site", F.lower("domain"))
    return report.speed_series(events, "ts", "1 hour", "site").select("site", F.unix_seconds("at").alias("moment"), "n")


@query(f"WITH {SERIES} SELECT * FROM series")
def speed_series(spark: SparkSession, folder: str) -> DataFrame:
    return _series(spark, folder)


@query(f"WITH {SERIES} SELECT site, moment, n, avg(n) OVER w AS mean, max(n) OVER w AS most FROM series WINDOW w AS (PARTITION BY site ORDER BY moment ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def speed_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return report.rolling(_series(spark, folder), ["site"], at="moment")


@query(f"""WITH {SERIES}, f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY moment) AS k, avg(n) OVER (PARTITION BY site ORDER BY moment ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS new,
    avg(n) OVER (PARTITION BY site ORDER BY moment ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS before, list(n) OVER (PARTITION BY site ORDER BY moment ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS head FROM series),
    g AS (SELECT *, CASE WHEN k >= 20 THEN before WHEN k >= 2 THEN list_avg(head[1:len(head) // 2]) END AS older FROM f)
    SELECT site, moment, n, CASE WHEN new > 1.1::DOUBLE * older THEN 'up' WHEN new < 0.9::DOUBLE * older THEN 'down' ELSE 'flat' END AS trend FROM g""")
def speed_trend(spark: SparkSession, folder: str) -> DataFrame:
    return report.trend(_series(spark, folder), ["site"], at="moment")


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY moment DESC) AS back FROM series), k AS (SELECT site, max(n) AS m, list(n ORDER BY moment) AS s FROM r WHERE back <= 60 GROUP BY site)
    SELECT site, array_to_string(list_transform(s, lambda v: CAST(floor(least(v::DOUBLE / m, 1.0) * 8) AS INT)), ',') AS levels,
    array_to_string(list_transform(s, lambda v: [' ', '▁', '▂', '▃', '▄', '▅', '▆', '▇', '█'][CAST(floor(least(v::DOUBLE / m, 1.0) * 8) AS INT) + 1]), '') AS line FROM k""")
def sparkline(spark: SparkSession, folder: str) -> DataFrame:
    return report.sparkline(_series(spark, folder), ["site"], at="moment")


@query("SELECT max(value) AS most, avg(value) AS mean, count(*) AS count FROM events WHERE value > 50")
def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = report.latency_stats(table(spark, folder, "events", "value"), "value", 50.0)
    return stats


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def latency_top(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@query("""SELECT CAST(extracted_at AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(extracted_at AS DATE)) AS BIGINT) AS total FROM scraped_items WHERE extracted_at IS NOT NULL GROUP BY 1""")
def persisted_total(spark: SparkSession, folder: str) -> DataFrame:
    """Items written day by day, and so far."""
    items = table(spark, folder, "scraped_items", "extracted_at").filter("extracted_at IS NOT NULL")
    days = items.groupBy(F.to_date("extracted_at").alias("day")).agg(F.count("*").alias("n"))
    return report.running_total(days, "n", "day")


@query("""SELECT coalesce(nullif(concat_ws('; ', CASE WHEN url IS NULL THEN 'url: required' END, CASE WHEN content IS NULL THEN 'content: required' END, CASE WHEN domain IS NULL THEN 'domain: required' END,
    CASE WHEN content_type IS NULL THEN 'content_type: invalid' END, CASE WHEN NOT coalesce(length(trim(title)) BETWEEN 1 AND 500, false) THEN 'title: invalid' END), ''), 'valid') AS outcome, count(*) AS items FROM scraped_items GROUP BY 1""")
def schema_split(spark: SparkSession, folder: str) -> DataFrame:
    """Items by what is wrong with them: the valid side and the dead-letter side of the sink."""
    items = table(spark, folder, "scraped_items", "url", "content", "domain", "content_type", "title")
    rules = {"content_type": F.col("content_type").isNotNull(), "title": F.char_length(F.trim("title")).between(1, 500)}
    errors = F.array_join(sinks.validation_errors(rules=rules), "; ")
    return items.groupBy(F.coalesce(F.nullif(errors, F.lit("")), F.lit("valid")).alias("outcome")).agg(F.count("*").alias("items"))


@query("""SELECT codec, count(*) AS pages, CAST(sum(strlen(coalesce(content, ''))) AS BIGINT) AS original, count(*) AS restored
    FROM scraped_items, (VALUES ('zstd'), ('gzip'), ('none')) AS c(codec) GROUP BY codec""")
def compression_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """How many contents come back whole from each codec, and their bytes."""
    items = table(spark, folder, "scraped_items", "item_id", "content")
    sums = items.select(F.col("item_id").alias("key"), F.md5(F.coalesce("content", F.lit(""))).alias("digest"))
    totals = None
    for codec in ("zstd", "gzip", "none"):
        text = F.pandas_udf(lambda data, codec=codec: data.map(lambda x: sinks.unpacked(x, codec)), "string")
        packed = sinks.packed_pages(items, "item_id", "content", codec).select("key", "original", F.md5(text("data")).alias("back"))
        part = packed.join(sums, "key").agg(F.count("*").alias("pages"), F.sum("original").alias("original"), F.count_if(F.col("back") == F.col("digest")).alias("restored"))
        part = part.select(F.lit(codec).alias("codec"), "pages", "original", "restored")
        totals = part if totals is None else totals.unionAll(part)
    return totals


@query()
def compression_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of all contents before and after compression, by codec."""
    items = table(spark, folder, "scraped_items", "item_id", "content")
    totals = None
    for codec in ("zstd", "gzip"):
        part = sinks.packed_pages(items, "item_id", "content", codec).agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"))
        part = part.select(F.lit(codec).alias("codec"), "original", "compressed", (100 - X.ratio_percent("compressed", "original")).alias("saved_percent"))
        totals = part if totals is None else totals.unionAll(part)
    return totals
