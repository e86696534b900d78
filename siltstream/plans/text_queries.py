"""Text, Markdown, metadata and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions import markdown as M
from siltstream.functions import text as X
from siltstream.plans.registry import query
from siltstream.sources.tables import table

BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _anchor(column: str) -> str:
    slug = rf"regexp_replace(regexp_replace(regexp_replace(lower({column}), '{BLANK}+', '-', 'g'), '[^a-z0-9\-]', '', 'g'), '-+', '-', 'g')"
    return f"coalesce(nullif(regexp_replace({slug}, '^-+|-+$', '', 'g'), ''), 'section')"


@query(f"SELECT DISTINCT h.text AS heading, {_anchor('h.text')} AS anchor FROM (SELECT unnest(metadata.headers) AS h FROM scraped_items) WHERE h.text IS NOT NULL")
def anchor_slug(spark: SparkSession, folder: str) -> DataFrame:
    headers = table(spark, folder, "scraped_items", "metadata.headers").select(F.explode("headers").alias("h"))
    return headers.select(F.col("h.text").alias("heading")).filter("heading IS NOT NULL").distinct().select("heading", X.anchor_slug("heading").alias("anchor"))


@query(f"""SELECT item_id, {stripped_sql("string_split(string_split(coalesce(nullif(metadata.og_title, ''), nullif(title, ''), 'Documento'), '|')[1], ' - ')[1]")} AS title FROM scraped_items""")
def title_clean(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "title", "metadata.og_title")
    return items.select("item_id", X.title_clean("og_title", "title").alias("title"))


@query(f"""SELECT item_id, array_to_string(list_filter(list_transform(string_split(concat_ws(', ', title, '', array_to_string(metadata.keywords, ' , '), domain), ','), lambda k: {stripped_sql('k')}), lambda k: k <> ''), ';') AS keywords FROM scraped_items""")
def keywords_split(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "title", "domain", "metadata.keywords")
    joined = F.concat_ws(", ", "title", F.lit(""), F.array_join("keywords", " , "), "domain")
    return items.select("item_id", F.array_join(X.keywords(joined), ";").alias("keywords"))


@query("SELECT item_id, md5(substring(content, 1, 10000)) AS content_key FROM scraped_items")
def content_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scraped_items", "item_id", "content").select("item_id", X.content_key("content").alias("content_key"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dupes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(rf"""SELECT doc_id, {stripped_sql("regexp_replace(text, '\n{3,}', E'\n\n', 'g')")} AS text FROM documents""")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", X.clean_text("text").alias("text"))


# The repair undoes what spoiled a text, so every text must come back.
@query("SELECT doc_id, true AS restored FROM documents WHERE text IS NOT NULL")
def repair_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text mis-read as Windows-1252 where it can be, and put right again."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    spoiled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    fixed = X.repair_text(spoiled)
    return docs.select("doc_id", (fixed == F.col("text")).alias("restored"))


@query(r"""SELECT item_id, array_to_string(list_slice(list_filter(list_transform(string_split(content, E'\n'), lambda x: trim(x)), lambda x: x <> ''), 1, 100), E'\n') AS head FROM scraped_items""")
def text_head(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "content")
    shown = F.filter(F.transform(F.split("content", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return items.select("item_id", F.array_join(F.slice(shown, 1, 100), "\n").alias("head"))


@query(f"""SELECT item_id, CASE WHEN len(shown) > 0 THEN '## Tabla de Contenidos' || chr(10) || chr(10) || array_to_string(list_transform(shown,
    lambda h: repeat('  ', h.level - 1) || '- [' || coalesce(h.text, '') || '](#' || coalesce(nullif(h.id, ''), {_anchor("coalesce(h.text, '')")}) || ')'), chr(10)) || chr(10) ELSE '' END AS toc
    FROM (SELECT item_id, list_filter(coalesce(metadata.headers, []), lambda h: h.level BETWEEN 1 AND 3) AS shown FROM scraped_items)""")
def toc(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "metadata.headers")
    return items.select("item_id", M.table_of_contents("headers").alias("toc"))


@query()
def enhance_markdown(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "url", "content", "metadata.headers")
    return items.select("item_id", M.enhanced("content", "headers", "url").alias("markdown"))


def _yaml_sql(value: str) -> str:
    """A string as YAML: as it is where that is safe, else in double quotes."""
    plain = f"regexp_full_match({value}, '[A-Za-z][A-Za-z0-9 _/.]*') AND trim({value}) = {value} AND lower({value}) NOT IN ('null', 'true', 'false', 'yes', 'no', 'on', 'off', 'y', 'n')"
    return f"CASE WHEN {plain} THEN {value} ELSE CAST(to_json({value}) AS VARCHAR) END"


def _frontmatter_sql() -> str:
    parts = []
    for key in sorted(("url", "title", "author", "date", "sitename", "ingestion_engine", "description", "keywords", "og_title", "og_description", "og_image", "og_type", "twitter_card", "twitter_site")):
        if key == "keywords":
            lines = f"array_to_string(list_transform(metadata.keywords, lambda k: '- ' || {_yaml_sql('k')} || chr(10)), '')"
            parts.append(f"CASE WHEN len(metadata.keywords) > 0 THEN 'keywords:' || chr(10) || {lines} ELSE '' END")
        else:
            parts.append(f"CASE WHEN metadata.{key} IS NULL THEN '' ELSE '{key}: ' || {_yaml_sql(f'metadata.{key}')} || chr(10) END")
    return "SELECT item_id, '---' || chr(10) || " + " || ".join(parts) + " || '---' || chr(10) || chr(10) AS frontmatter FROM scraped_items"


@query(_frontmatter_sql())
def frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "metadata")
    kept = F.struct(*[F.col(f"metadata.{k}").alias(k) for k in M.FRONTMATTER_KEYS])
    return items.select("item_id", M.frontmatter(kept).alias("frontmatter"))


@query("""SELECT item_id, json_valid(metadata.json_ld) AS parses, CASE WHEN json_valid(metadata.json_ld) THEN json_extract_string(metadata.json_ld, '$.inLanguage') END AS language
    FROM scraped_items WHERE metadata.json_ld IS NOT NULL""")
def jsonld_first(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "metadata.json_ld").filter("json_ld IS NOT NULL")
    parsed = F.try_parse_json("json_ld")
    return items.select("item_id", parsed.isNotNull().alias("parses"), F.try_variant_get(parsed, "$.inLanguage", "string").alias("language"))


@query("""SELECT item_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0)
    WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END AS size,
    CASE WHEN n < 10485760 THEN 'small' WHEN n < 52428800 THEN 'medium' ELSE 'large' END AS tier, CASE WHEN n >= 52428800 THEN 'mmap' WHEN n > 10485760 THEN 'streaming' ELSE 'direct' END AS strategy
    FROM (SELECT item_id, strlen(content)::BIGINT * 4096 AS n FROM scraped_items WHERE content IS NOT NULL)""")
def size_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes in words, tiers and ways of writing, of contents taken as blocks of 4 KB."""
    items = table(spark, folder, "scraped_items", "item_id", "content").filter("content IS NOT NULL")
    sized = items.select("item_id", (F.octet_length("content").cast("long") * 4096).alias("n"))
    return sized.select("item_id", X.human_size("n").alias("size"), X.size_tier("n").alias("tier"), X.write_strategy("n").alias("strategy"))


@query("""SELECT event_id, CASE WHEN s < 0 THEN '∞' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS elapsed,
    CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS ago,
    CASE WHEN value > 80 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'ok' END AS band,
    pow(2.0, event_id % 7) AS page_wait, least(pow(2.0, event_id % 7), 30.0) AS transport_wait
    FROM (SELECT event_id, value, CAST(floor(value * 60) AS BIGINT) AS s FROM events WHERE value IS NOT NULL)""")
def display_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Times, bands and waits as they are shown."""
    events = table(spark, folder, "events", "event_id", "value").filter("value IS NOT NULL").withColumn("s", F.floor(F.col("value") * 60).cast("long"))
    n = F.col("event_id") % 7
    return events.select("event_id", X.elapsed("s").alias("elapsed"), X.ago("s").alias("ago"), X.band("value", 50, 80).alias("band"), X.page_backoff(n).alias("page_wait"), X.transport_wait(n + 1, 1.0, 30.0).alias("transport_wait"))


@query("SELECT url, left(coalesce(last_error, ''), 500) AS stored, CASE WHEN length(last_error) > 20 THEN left(last_error, 20) || '...' ELSE last_error END AS shown, count(*) AS n FROM urls GROUP BY ALL")
def error_display(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "urls", "url", "last_error")
    return urls.select("url", F.left(F.coalesce("last_error", F.lit("")), F.lit(500)).alias("stored"), X.shortened("last_error", 20).alias("shown")).groupBy("url", "stored", "shown").agg(F.count("*").alias("n"))
