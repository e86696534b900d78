"""Views of an engine: pages of the store, logs, reports, requests that are tried again, breaker states at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstream.functions import markdown
from siltstream.functions import text as X
from siltstream.functions import urls as U
from siltstream.operators import activity, frontier, report, state, transport
from siltstream.operators.policies import fold
from siltstream.plans.crawl_queries import BELOW, KIND, LINKS, NETLOC, SCHEME, recoded_sql
from siltstream.plans.policy_queries import ENGINE, _breaker_sql
from siltstream.plans.registry import query
from siltstream.sources.tables import table

# Deliveries as an activity log: a delivery without content is an error, one without a title a warning.
ACTIVITY = """a AS (SELECT item_id AS seq, epoch_us(extracted_at) AS moment, url, title, metadata.ingestion_engine AS engine,
    CASE WHEN content IS NULL OR trim(content) = '' THEN 'error' WHEN title IS NULL THEN 'warning' ELSE 'completed' END AS status,
    CASE WHEN content IS NULL THEN 'no content' END AS error FROM scraped_items)"""


def _activity(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "extracted_at", "url", "title", "content", "metadata.ingestion_engine")
    blank = F.col("content").isNull() | (F.trim("content") == "")
    status = F.when(blank, "error").when(F.col("title").isNull(), "warning").otherwise("completed")
    return items.select(
        F.col("item_id").alias("seq"), F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("at"), "url", "title", F.col("ingestion_engine").alias("engine"),
        status.alias("status"), F.when(F.col("content").isNull(), "no content").alias("error"),
    )


@query(f"""WITH {ACTIVITY} SELECT seq, moment AS "at", coalesce(url, '') AS url, 'ProcessingError' AS error_type, coalesce(error, 'Unknown error') AS error_message, 0 AS retry_count
    FROM (SELECT * FROM a ORDER BY seq DESC LIMIT 500) WHERE status = 'error'""")
def error_list(spark: SparkSession, folder: str) -> DataFrame:
    """The errors among the last 500 deliveries."""
    return activity.error_list(_activity(spark, folder), 500)


LINES = """SELECT seq, moment AS "at", CASE status WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARNING' ELSE 'INFO' END AS level,
    coalesce(nullif(title, ''), nullif(error, ''), nullif(status, ''), '') || CASE WHEN coalesce(url, '') <> '' THEN ': ' || url ELSE '' END AS message, coalesce(engine, 'engine') AS source"""


@query(f"WITH {ACTIVITY} {LINES} FROM (SELECT * FROM a ORDER BY seq DESC LIMIT 1000) WHERE status <> 'error' AND status <> 'completed'")
def log_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """The warnings among the last 1000 log lines."""
    return activity.log_lines(_activity(spark, folder), 1000, "warning")


@query(f"WITH {ACTIVITY}, l AS ({LINES} FROM a) SELECT * FROM l WHERE regexp_matches(message, '(?i)news') OR regexp_matches(source, '(?i)news')")
def log_search(spark: SparkSession, folder: str) -> DataFrame:
    """All log lines that contain a word, of a log without a limit."""
    rows = _activity(spark, folder)
    lines = rows.select("seq", "at", activity.level("status").alias("level"), activity.message().alias("message"), F.coalesce("engine", F.lit(activity.SOURCE)).alias("source"))
    return activity.search(lines, "News")


@query("""SELECT count(*) FILTER (type = 'webpage' AND status <> 'failed') AS pages_completed, count(*) FILTER (type = 'webpage' AND status = 'failed') AS pages_failed,
    count(*) FILTER (type = 'asset' AND status <> 'failed') AS assets_completed, count(*) FILTER (type = 'asset' AND status = 'failed') AS assets_failed,
    count(*) FILTER (type IN ('webpage', 'asset') AND status = 'failed') AS error_count FROM urls WHERE status IN ('completed', 'failed')""")
def mission_counters(spark: SparkSession, folder: str) -> DataFrame:
    tried = table(spark, folder, "urls", "type", "status").filter(F.col("status").isin("completed", "failed"))
    return activity.mission_counters(tried.withColumn("status", F.when(F.col("status") == "failed", "error").otherwise("completed")), "type")


@query("SELECT url, status, type, retries FROM urls ORDER BY url NULLS FIRST, status NULLS FIRST, type NULLS FIRST, retries NULLS FIRST LIMIT 100 OFFSET 250")
def store_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of the store, of 100 rows from row 250 on."""
    return state.page(table(spark, folder, "urls", "url", "status", "type", "retries"), 100, 250)


@query("""WITH t AS (SELECT coalesce(status, '(none)') AS name, count(*) AS value FROM urls GROUP BY 1),
    e AS (SELECT coalesce(last_error, 'Unknown') AS error, last_error IS NULL AS missing, count(*) AS value FROM urls WHERE status = 'failed' GROUP BY 1, 2 ORDER BY value DESC, error, missing LIMIT 5)
    SELECT 'status' AS section, name, value FROM t UNION ALL SELECT 'total', 'TOTAL', count(*) FROM urls
    UNION ALL SELECT 'error', CASE WHEN length(error) > 80 THEN left(error, 80) || '...' ELSE error END, value FROM e""")
def mission_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.mission_report(table(spark, folder, "urls", "status", "last_error"))


# Events of a site in one minute as the attempts of one request.
ATTEMPTS = """t AS (SELECT lower(domain) || '|' || CAST(epoch_us(ts) // 60000000 AS VARCHAR) AS request,
    row_number() OVER (PARTITION BY lower(domain), epoch_us(ts) // 60000000 ORDER BY ts, ok NULLS FIRST) AS attempt,
    CASE WHEN ok THEN 200 WHEN NOT ok THEN 503 END AS status FROM breaker_events WHERE ts IS NOT NULL AND domain IS NOT NULL)"""


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "breaker_events", "domain", "ts", "ok").filter("ts IS NOT NULL AND domain IS NOT NULL")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)).cast("string")
    rows = events.select(F.concat(F.lower("domain"), F.lit("|"), minute).alias("request"), "ts", "ok", F.when(F.col("ok"), 200).when(~F.col("ok"), 503).alias("status"))
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy("request").orderBy("ts", F.col("ok").asc_nulls_first())))


@query(f"""WITH {ATTEMPTS}, f AS (SELECT * FROM t WHERE attempt <= 3),
    e AS (SELECT request, min(attempt) AS ended FROM f WHERE coalesce(status < 500, false) GROUP BY request),
    l AS (SELECT request, max(attempt) AS last FROM f GROUP BY request)
    SELECT f.request, CAST(CASE WHEN ended IS NULL AND last >= 3 THEN 504 ELSE f.status END AS INTEGER) AS status, CAST(f.attempt AS INTEGER) AS attempts,
        CAST(CASE f.attempt WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS DOUBLE) AS waited
    FROM l LEFT JOIN e USING (request) JOIN f ON f.request = l.request AND f.attempt = coalesce(ended, last)""")
def transport_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How each request ends that is tried three times at most."""
    return transport.outcomes(_attempts(spark, folder).select("request", "attempt", "status"))


@query(f"""WITH {ATTEMPTS} SELECT request, 'network_retry' AS kind, CAST(attempt AS INTEGER) AS attempt, status, CAST(CASE attempt WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS wait
    FROM t WHERE coalesce(status >= 500, true) AND attempt < 3""")
def retry_events(spark: SparkSession, folder: str) -> DataFrame:
    return transport.retry_events(_attempts(spark, folder).select("request", "attempt", "status"))


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "breaker_events", "domain", "ts", "ok").filter("ts IS NOT NULL").select(F.lower("domain").alias("site"), "ts", "ok")
    return fold(events, ENGINE, "site", "ts", "ok")


@query(f"""WITH b AS ({_breaker_sql(ENGINE)}), c AS (SELECT site, moment, max(state = 'open') AS open FROM b WHERE allowed AND site IS NOT NULL GROUP BY ALL),
    q AS (SELECT DISTINCT lower(domain) AS site, epoch_us(ts) // 600000000 * 600000000 AS asked FROM breaker_events WHERE ts IS NOT NULL AND domain IS NOT NULL)
    SELECT q.site, q.asked, CASE WHEN NOT coalesce(c.open, false) THEN 'closed' WHEN q.asked < c.moment + {ENGINE.timeout} THEN 'open' ELSE 'half-open' END AS state
    FROM q ASOF LEFT JOIN c ON q.site = c.site AND q.asked >= c.moment""")
def breaker_states(spark: SparkSession, folder: str) -> DataFrame:
    """The breaker's state of each site at every ten minutes in which it has an event."""
    events = table(spark, folder, "breaker_events", "domain", "ts").filter("ts IS NOT NULL AND domain IS NOT NULL")
    tens = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(600_000_000)) * 600_000_000
    asked = events.select(F.lower("domain").alias("site"), F.timestamp_micros(tens).alias("asked")).distinct()
    found = transport.breaker_states(_folded(spark, folder).filter("site IS NOT NULL"), asked, ENGINE, "site", "ts")
    return found.select("site", F.unix_micros("asked").alias("asked"), "state")


@query(f"""WITH b AS ({_breaker_sql(ENGINE)}), s AS (SELECT site, moment, state, lag(state, 1, 'closed') OVER (PARTITION BY site ORDER BY moment, failures) AS before FROM b)
    SELECT site, 'circuit_state' AS kind, count(*) FILTER (state = 'open') AS opened, count(*) FILTER (state = 'closed') AS closed FROM s WHERE state <> before GROUP BY site""")
def circuit_events(spark: SparkSession, folder: str) -> DataFrame:
    """How often each site's breaker opened and closed."""
    changed = transport.circuit_events(_folded(spark, folder), "site", "ts")
    return changed.groupBy("site", "kind").agg(F.count_if(F.col("state") == "open").alias("opened"), F.count_if(F.col("state") == "closed").alias("closed"))


@query("""SELECT DISTINCT n_chars, printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS span, strftime(make_timestamp(n_chars * 1000000), '%H:%M:%S') AS shown
    FROM documents WHERE n_chars >= 0""")
def clock_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of characters read as seconds, as time spans and as times of day."""
    numbers = table(spark, folder, "documents", "n_chars").filter("n_chars >= 0").distinct()
    return numbers.select("n_chars", X.clock_time("n_chars").alias("span"), X.time_of_day("n_chars").alias("shown"))


_SEED = f"({SCHEME.format('url')} || '://' || {NETLOC.format('url')} || '/news')"


@query(f"SELECT DISTINCT url, {BELOW.format('url', _SEED)} AS inside FROM urls")
def scope_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """The strict scope of a seed that ends in a slash, where such a seed has children."""
    urls = table(spark, folder, "urls", "url").distinct()
    return urls.select("url", U.in_scope("url", F.concat(U.origin("url"), F.lit("/news/")), "strict", strict_fixed=True).alias("inside"))


def _normalized_sql(url: str) -> str:
    """An address with its path and query encoded one way, as one expression."""
    fields = f"list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda f: f <> '')"
    code = lambda text: f"replace(url_encode(url_decode(replace({text}, '+', ' '))), '%20', '+')"
    name, value = "string_split(f, '=')[1]", "CASE WHEN contains(f, '=') THEN substr(f, instr(f, '=') + 1) ELSE '' END"
    query_ = f"array_to_string(list_transform({fields}, lambda f: {code(name)} || '=' || {code(value)}), '&')"
    head, path = (f"regexp_extract({url}, '^([^?#]*://[^/?#]*)([^?#]*)', {k})" for k in (1, 2))
    return f"{head} || {recoded_sql(path)} || CASE WHEN {query_} <> '' THEN '?' || {query_} ELSE '' END"


@query(f"WITH {LINKS} SELECT DISTINCT page, {_normalized_sql('url')} AS url, {KIND.format('(' + _normalized_sql('url') + ')')} AS kind FROM links")
def link_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The links of one round with addresses in one encoding as their keys."""
    items = table(spark, folder, "scraped_items", "url", "content")
    return frontier.triage(frontier.edges(items, "url", frontier.markdown_links("content")), normalize_keys=True)


@query()
def page_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered page as one text: frontmatter, table of contents, Markdown with absolute links."""
    items = table(spark, folder, "scraped_items", "item_id", "url", "content", "metadata")
    return items.select("item_id", markdown.document("metadata", "content", "metadata.headers", "url").alias("document"))
