"""Links, triage and the frontier of a crawl as joins and distincts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions.urls import admissible, in_scope, link_kind, normalize_url, resolved
from siltstream.session import materialize, release

#: Rounds whose tables are read side by side before they are written as one.
TOGETHER = 20

_MARKDOWN_LINK = r"\]\(([^()\s]+)\)"
_HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']([^"']+)["']"""
_SRC = r"""(?i)<img\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""


def markdown_links(text: str | Column) -> Column:
    """The targets of a Markdown text's links and images, in order."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(_MARKDOWN_LINK), 1)


def html_links(html: str | Column) -> Column:
    """The targets of anchors and then of images of well-formed HTML; the page parser finds those of any."""
    h = F.col(html) if isinstance(html, str) else html
    return F.concat(F.regexp_extract_all(h, F.lit(_HREF), 1), F.regexp_extract_all(h, F.lit(_SRC), 1))


def edges(pages: DataFrame, url: str, links: Column) -> DataFrame:
    """(page, href): one row for each distinct link of each page; pages without links give none."""
    return pages.select(F.col(url).alias("page"), F.explode(F.array_distinct(links)).alias("href")).filter("href <> ''")


def triage(found: DataFrame, scope: str = "smart", base: Column | None = None, normalize_keys: bool = False, strict_fixed: bool = False) -> DataFrame:
    """(page, url, kind): absolute links that are followed, as webpages or assets; noise and other sites go.

    The seed is the page's own origin unless ``base`` names it. With ``normalize_keys`` addresses that differ in their
    encoding alone are one.
    """
    rows = found.select("page", resolved("page", "href").alias("url")).filter("url IS NOT NULL")
    if normalize_keys:
        rows = rows.select("page", normalize_url("url").alias("url"))
    seed = base if base is not None else F.regexp_extract("page", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    kept = rows.withColumn("kind", link_kind("url")).filter((F.col("kind") != "noise") & in_scope("url", seed, scope, strict_fixed))
    return kept.distinct()


def new_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """(url, kind) of the found links that the store does not know yet and may take, once each."""
    fresh = found.filter(admissible("url")).select("url", "kind").distinct()
    return fresh.join(known.select("url").distinct(), "url", "left_anti")


def reach(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, depth): everything that (src, dst) links lead to from the seeds, by rounds until nothing is new.

    A round is one join with the last round's pages and one anti join with all. Each is written, and every
    TOGETHER rounds all are written as one table, so the plan does not grow with the depth.
    """
    graph = materialize(graph.select("src", "dst").distinct(), "graph")
    seen = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reach")
    last, depth, rounds = seen, 0, [seen]
    while True:
        depth += 1
        step = graph.join(last.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        last = materialize(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if last.isEmpty():
            return seen
        seen = seen.unionAll(last)
        rounds.append(last)
        if depth % TOGETHER == 0:
            seen = materialize(seen, "reach")
            for done in rounds[:-1]:
                release(done)
            rounds = [seen, last]
