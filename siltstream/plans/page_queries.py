"""Pages with HTML, rendered from the delivered items, and asset routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import assets, mission, pages, report
from siltstream.plans.crawl_queries import KIND, NETLOC, SCHEME, slug_sql
from siltstream.plans.registry import query
from siltstream.plans.text_queries import stripped_sql
from siltstream.sources.tables import table


def _parsed(spark: SparkSession, folder: str, *parts: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "url", "content", "metadata")
    return pages.parse_pages(pages.rendered(items), keep=("item_id",), parts=parts)


@query(f"""SELECT item_id, url, {stripped_sql("string_split(string_split(coalesce(nullif(metadata.og_title, ''), nullif(metadata.title, ''), 'Documento'), '|')[1], ' - ')[1]")} AS title,
    coalesce(nullif(metadata.author, ''), 'Desconocido') AS author, {NETLOC.format('url')} AS sitename, nullif(metadata.description, '') AS description,
    coalesce(array_to_string(metadata.keywords, ';'), '') AS keywords FROM scraped_items""")
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    m = "metadata."
    return _parsed(spark, folder, "metadata").select("item_id", m + "url", m + "title", m + "author", m + "sitename", m + "description", F.array_join(m + "keywords", ";").alias("keywords"))


@query()
def html_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned HTML of every page."""
    items = table(spark, folder, "scraped_items", "item_id", "url", "content", "metadata")
    return pages.parse_pages(pages.rendered(items), keep=("item_id",), extractor=pages.clean_record, schema=pages.CLEAN)


@query()
def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "engine", "markdown").select("item_id", "engine", "markdown")


@query(r"""SELECT item_id, 1 + coalesce(len(regexp_extract_all(content, '\[[^\[\]]*\]\([^()\s]+\)')), 0) AS links FROM scraped_items""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of each page: those of its text and the one of its menu."""
    return _parsed(spark, folder, "links").select("item_id", F.size("links").cast("long").alias("links"))


@query()
def link_density(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "link_density").select("item_id", F.round("link_density", 6).alias("link_density"))


@query(rf"""WITH RECURSIVE pages AS (SELECT url, content FROM (SELECT url, content, row_number() OVER (PARTITION BY url ORDER BY item_id) AS rn FROM scraped_items) WHERE rn = 1),
    hrefs AS (SELECT url AS page, unnest(list_append(coalesce(regexp_extract_all(content, '\[[^\[\]]*\]\(([^()\s]+)\)', 1), []), '/')) AS href FROM pages),
    joined AS (SELECT page, string_split(CASE WHEN starts_with(href, '/') THEN {SCHEME.format('page')} || '://' || {NETLOC.format('page')} || href
        WHEN starts_with(href, '#') THEN page ELSE href END, '#')[1] AS url FROM hrefs),
    links AS (SELECT DISTINCT page, url FROM joined WHERE {KIND.format('url')} <> 'noise' AND {NETLOC.format('url')} = {NETLOC.format('page')}),
    reached AS (SELECT DISTINCT url FROM scraped_items WHERE content_type = 'faq' UNION
        SELECT l.url FROM links l JOIN reached r ON l.page = r.url WHERE {KIND.format('r.url')} = 'webpage')
    SELECT {KIND.format('url')} AS type, CASE WHEN {KIND.format('url')} = 'asset' THEN 'pending' WHEN url IN (SELECT url FROM pages) THEN 'completed' ELSE 'failed' END AS status, count(*) AS urls
    FROM reached GROUP BY ALL""")
def mission_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """A whole mission from the FAQ pages over the rendered pages: the store's histogram when nothing is pending."""
    items = table(spark, folder, "scraped_items", "item_id", "url", "content", "content_type", "metadata")
    first = report.first_of_each(items, "url", "item_id")
    html = pages.rendered(first).select("url", F.lit(200).alias("status"), "html")
    seeds = items.filter("content_type = 'faq'").select("url")
    done = mission.run(html, mission.seeded(seeds))
    return done.store.groupBy("type", "status").agg(F.count("*").alias("urls"))


@query(r"""SELECT url, lower(regexp_extract(last, '^.+(\.[^.]+)$', 1)) AS extension, CASE WHEN regexp_matches(last, '^.+\.[^.]+$') THEN regexp_replace(last, '\.[^.]+$', '') ELSE last END AS stem,
    CASE WHEN lower(regexp_extract(last, '^.+(\.[^.]+)$', 1)) IN ('.pdf', '.docx', '.pptx', '.xlsx', '.md', '.txt', '.csv') THEN 'docs' ELSE 'images' END AS folder
    FROM (SELECT DISTINCT url, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS last FROM urls WHERE type = 'asset')""")
def asset_route(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "urls", "url", "type").filter("type = 'asset'").select("url").distinct()
    return urls.select("url", assets.extension("url").alias("extension"), assets.stem("url").alias("stem"), assets.folder("url").alias("folder"))


@query(rf"""SELECT url, {slug_sql(r"coalesce(nullif(CASE WHEN regexp_matches(last, '^.+\.[^.]+$') THEN regexp_replace(last, '\.[^.]+$', '') ELSE last END, ''), 'asset')")} || lower(regexp_extract(last, '^.+(\.[^.]+)$', 1)) AS file_name
    FROM (SELECT DISTINCT url, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS last FROM urls WHERE type = 'asset')""")
def asset_files(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "urls", "url", "type").filter("type = 'asset'").select("url").distinct()
    return urls.select("url", assets.file_name("url").alias("file_name"))
