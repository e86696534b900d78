"""URLs, links, scope, frontier, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions import urls as U
from siltstream.operators import frontier, gating, state
from siltstream.plans.registry import query
from siltstream.sources.tables import table

SCHEME = r"lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1))"
NETLOC = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
ASSET = r"regexp_matches(lower({0}), '\.(pdf|jpg|png|jpeg|gif|svg|webp|md|txt|csv)$')"
NOISE = r"regexp_matches(lower({0}), '\.(css|js|json|xml|ico)$')"
KIND = f"CASE WHEN {ASSET} THEN 'asset' WHEN {NOISE} THEN 'noise' ELSE 'webpage' END"
ADMISSIBLE = f"coalesce({SCHEME} <> '' AND {NETLOC} <> '' AND length({{0}}) <= 2048, false)"
BELOW = "({0} = {1} OR starts_with(CASE WHEN starts_with({0}, {1}) THEN substr({0}, length({1}) + 1) ELSE {0} END, '/'))"

# Every delivered page with its links, absolute: root-relative, absolute, and anchors of the page itself.
LINKS = rf"""
    hrefs AS (SELECT DISTINCT url AS page, unnest(regexp_extract_all(content, '\]\(([^()\s]+)\)', 1)) AS href FROM scraped_items),
    joined AS (SELECT page, string_split(CASE WHEN starts_with(href, '/') THEN {SCHEME.format('page')} || '://' || {NETLOC.format('page')} || href
        WHEN starts_with(href, '#') THEN page ELSE href END, '#')[1] AS url FROM hrefs),
    links AS (SELECT DISTINCT page, url, {KIND.format('url')} AS kind FROM joined
        WHERE {KIND.format('url')} <> 'noise' AND {NETLOC.format('url')} = {NETLOC.format('page')}),
    fresh AS (SELECT DISTINCT url, kind FROM links l WHERE {ADMISSIBLE.format('url')} AND NOT EXISTS (SELECT 1 FROM urls u WHERE u.url = l.url))"""


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scraped_items", "item_id", "url", "content")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.triage(frontier.edges(_items(spark, folder), "url", frontier.markdown_links("content")))


@query(f"""SELECT DISTINCT url, {SCHEME.format('url')} AS scheme, {NETLOC.format('url')} AS netloc, {PATH.format('url')} AS path,
    {KIND.format('url')} AS kind, {ADMISSIBLE.format('url')} AS admissible FROM urls""")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "urls", "url").distinct()
    return urls.select("url", U.scheme("url").alias("scheme"), U.netloc("url").alias("netloc"), U.path("url").alias("path"), U.link_kind("url").alias("kind"), U.admissible("url").alias("admissible"))


@query(f"""SELECT {KIND.format('url')} AS kind, {ADMISSIBLE.format('url')} AS admissible, count(*) AS rows FROM urls GROUP BY ALL""")
def url_admission(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "urls", "url")
    return urls.groupBy(U.link_kind("url").alias("kind"), U.admissible("url").alias("admissible")).agg(F.count("*").alias("rows"))


def recoded_sql(text: str) -> str:
    """Percent-encoding of a path brought to one form."""
    return f"replace(url_encode(url_decode({text})), '%2F', '/')"


@query(rf"""WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^([^?#]*://[^/?#]*)([^?#]*)', 1) AS head, regexp_extract(url, '^([^?#]*://[^/?#]*)([^?#]*)', 2) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS asked, regexp_extract(url, '#(.*)$', 1) AS fragment FROM urls WHERE url IS NOT NULL),
    q AS (SELECT *, list_transform(list_filter(string_split(asked, '&'), lambda f: f <> ''), lambda f: replace(url_encode(url_decode(replace(string_split(f, '=')[1], '+', ' '))), '%20', '+')
        || '=' || replace(url_encode(url_decode(replace(CASE WHEN contains(f, '=') THEN substr(f, instr(f, '=') + 1) ELSE '' END, '+', ' '))), '%20', '+')) AS fields FROM p)
    SELECT url, head || {recoded_sql('path')} || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS normalized FROM q""")
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "urls", "url").distinct()
    return urls.select("url", U.normalize_url("url").alias("normalized"))


@query("SELECT DISTINCT url, CASE WHEN length(url) <= 40 THEN url ELSE left(url, 18) || '...' || right(url, 18) END AS shown FROM urls")
def url_middle_cut(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "urls", "url").distinct().select("url", U.middle_cut("url", 40).alias("shown"))


def slug_sql(text: str) -> str:
    """The slug of a text whose letters decompose into a Latin letter and an accent, or are no letters of a slug."""
    plain = f"regexp_replace(lower(strip_accents(replace(replace({text}, '’', '-'), chr(39), '-'))), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""SELECT DISTINCT url, coalesce(nullif({slug_sql(f"CASE WHEN starts_with(url, {SCHEME.format('url')} || '://' || {NETLOC.format('url')}) THEN substr(url, length({SCHEME.format('url')} || '://' || {NETLOC.format('url')}) + 1) ELSE url END")}, ''), 'index') AS file
    FROM scraped_items""")
def page_files(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "url").distinct()
    return items.select("url", U.page_file("url", U.origin("url")).alias("file"))


@query(r"SELECT item_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT item_id, unnest(regexp_extract_all(content, '\]\(([^()\s]+)\)', 1)) AS href FROM scraped_items) GROUP BY item_id")
def link_extract(spark: SparkSession, folder: str) -> DataFrame:
    links = frontier.markdown_links("content")
    found = _items(spark, folder).select("item_id", links.alias("links")).filter(F.size("links") > 0)
    return found.select("item_id", F.size("links").cast("long").alias("links"), F.size(F.array_distinct("links")).cast("long").alias("targets"))


@query(f"WITH {LINKS} SELECT DISTINCT page, url FROM joined")
def link_resolve(spark: SparkSession, folder: str) -> DataFrame:
    found = frontier.edges(_items(spark, folder), "url", frontier.markdown_links("content"))
    return found.select("page", U.resolved("page", "href").alias("url")).distinct()


@query(f"WITH {LINKS} SELECT page, url, kind FROM links")
def link_triage(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder)


def _scope(name: str, rule: str) -> None:
    base = f"{SCHEME.format('url')} || '://' || {NETLOC.format('url')} || '/news'"
    root = f"{SCHEME.format('url')} || '://' || {NETLOC.format('url')}"
    sql = f"SELECT DISTINCT url, {rule.format(BELOW.format('url', '(' + base + ')'))} AS inside, {'true' if name != 'strict' else BELOW.format('url', '(' + root + ')')} AS inside_root FROM urls"

    def run(spark: SparkSession, folder: str) -> DataFrame:
        urls = table(spark, folder, "urls", "url").distinct()
        seed = F.concat(U.origin("url"), F.lit("/news"))
        return urls.select("url", U.in_scope("url", seed, name).alias("inside"), U.in_scope("url", U.origin("url"), name).alias("inside_root"))

    run.__name__ = f"scope_{name}"
    query(sql)(run)


for _name, _rule in (("broad", "true"), ("strict", "{0}"), ("smart", "{0}")):
    _scope(_name, _rule)


@query(f"""WITH {LINKS}, store AS (SELECT url, status, type FROM urls UNION ALL SELECT url, 'pending', kind FROM fresh)
    SELECT status, type, count(*) AS count FROM store GROUP BY status, type""")
def frontier_round(spark: SparkSession, folder: str) -> DataFrame:
    """The store's histogram after one crawl round: links found, triaged, and inserted where not known."""
    store = table(spark, folder, "urls")
    fresh = frontier.new_urls(_links(spark, folder), store)
    rows = fresh.select("url", F.lit("pending").alias("status"), F.col("kind").alias("type"), F.lit(0).alias("retries"))
    after, _ = state.insert_ignore(store, rows, F.col("type"))
    return after.groupBy("status", "type").agg(F.count("*").alias("count"))


@query(f"""WITH {LINKS} SELECT {NETLOC.format('url')} AS host, count(*) FILTER (kind = 'webpage') AS new_pages, count(*) FILTER (kind = 'asset') AS new_assets
    FROM fresh GROUP BY 1""")
def frontier_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """What one round discovers, by host."""
    fresh = frontier.new_urls(_links(spark, folder), table(spark, folder, "urls", "url"))
    return fresh.groupBy(U.netloc("url").alias("host")).agg(F.count_if(F.col("kind") == "webpage").alias("new_pages"), F.count_if(F.col("kind") == "asset").alias("new_assets"))


@query(f"""WITH RECURSIVE {LINKS}, seeds AS (SELECT DISTINCT url FROM scraped_items WHERE content_type = 'faq'),
    reached AS (SELECT url FROM seeds UNION SELECT l.url FROM links l JOIN reached r ON l.page = r.url)
    SELECT {KIND.format('url')} AS kind, count(*) AS reached FROM reached GROUP BY 1""")
def frontier_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Everything the FAQ pages lead to, by breadth-first rounds."""
    graph = _links(spark, folder).select(F.col("page").alias("src"), F.col("url").alias("dst"))
    seeds = table(spark, folder, "scraped_items", "url", "content_type").filter("content_type = 'faq'").select("url")
    found = frontier.reach(graph, seeds)
    return found.groupBy(U.link_kind("url").alias("kind")).agg(F.count("*").alias("reached"))


def _challenge_sql(column: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(lower({column}), '{m}')''' for m in marks)} THEN '{kind}'" for kind, marks in gating.CHALLENGES.items())
    return f"CASE {cases} END"


@query(f"SELECT challenge, count(*) AS pages FROM (SELECT {_challenge_sql('content')} AS challenge FROM scraped_items UNION ALL SELECT {_challenge_sql('text')} FROM documents) GROUP BY 1")
def captcha_detect(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "scraped_items", "content").unionAll(table(spark, folder, "documents", "text"))
    return texts.groupBy(gating.challenge("content").alias("challenge")).agg(F.count("*").alias("pages"))


@query(r"""SELECT status, CASE WHEN status = 200 THEN 'ok' WHEN status = 500 THEN 'empty' WHEN status IN (401, 403, 429) THEN 'blocked' ELSE 'error' END AS class, count(*) AS urls
    FROM (SELECT CAST(nullif(regexp_extract(last_error, '^HTTP (\d{3})', 1), '') AS INT) AS status FROM urls WHERE last_error IS NOT NULL) GROUP BY ALL""")
def response_classes(spark: SparkSession, folder: str) -> DataFrame:
    errors = table(spark, folder, "urls", "last_error").filter("last_error IS NOT NULL")
    status = F.nullif(F.regexp_extract("last_error", r"^HTTP (\d{3})", 1), F.lit("")).cast("int")
    return errors.select(status.alias("status")).groupBy("status", gating.response_class("status").alias("class")).agg(F.count("*").alias("urls"))


@query(f"""SELECT DISTINCT url, CASE WHEN ends_with({NETLOC.format('url')}, '.invalid') THEN false
    WHEN ends_with({NETLOC.format('url')}, '.test') THEN NOT starts_with({PATH.format('url')}, '/culture') ELSE true END AS allowed FROM urls WHERE url IS NOT NULL""")
def robots_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Rules by origin: a forbidden file for .invalid hosts, one rule for .test hosts, none for the rest."""
    urls = table(spark, folder, "urls", "url").filter("url IS NOT NULL").distinct()
    origins = urls.select(U.origin("url").alias("origin")).distinct()
    forbidden, ruled = F.col("origin").endswith(".invalid"), F.col("origin").endswith(".test")
    robots = origins.filter(forbidden | ruled).select("origin", F.when(forbidden, 403).otherwise(200).alias("status"), F.lit("User-agent: *\nDisallow: /culture\n").alias("body"))
    return gating.robots_gate(urls, robots).select("url", "allowed")
