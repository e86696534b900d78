"""Pages parsed once: metadata, Markdown, links and density in a single Arrow pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.session import spread

S = T.StringType()
HEADER = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", S), T.StructField("id", S)])
METADATA = T.StructType(
    [T.StructField(n, S) for n in ("url", "title", "author", "date", "sitename", "ingestion_engine", "description")]
    + [T.StructField("keywords", T.ArrayType(S))]
    + [T.StructField(n, S) for n in ("og_title", "og_description", "og_image", "og_type", "twitter_card", "twitter_site", "twitter_title", "json_ld")]
    + [T.StructField("headers", T.ArrayType(HEADER))]
)
PAGE = T.StructType([
    T.StructField("metadata", METADATA), T.StructField("markdown", S), T.StructField("engine", S),
    T.StructField("links", T.ArrayType(S)), T.StructField("images", T.ArrayType(S)), T.StructField("link_density", T.DoubleType()),
])

Extractor = Callable[[str | None, str | None], dict]


#: The parts of a page, each of which costs only those who ask for it.
PARTS = ("metadata", "markdown", "engine", "links", "images", "link_density")


def page_record(html: str | None, url: str | None, parts: tuple[str, ...] = PARTS, longest: int | None = None, most_lines: int | None = None) -> dict:
    """What is read from one page: the ``parts`` asked for.

    Metadata, links and images come from the page as it is, its text from the cleaned page. ``longest`` limits the
    characters that the text is read from, ``most_lines`` the lines of a page without paragraphs; by default both are
    read whole.
    """
    from siltstream.html.clean import capped, link_density, prune_links, remove_furniture, sanitize
    from siltstream.html.convert import extract
    from siltstream.html.dom import parse
    from siltstream.html.meta import metadata

    if not html:
        empty = {"metadata": None, "markdown": "", "engine": "none", "links": [], "images": [], "link_density": 0.0}
        return {part: empty[part] for part in parts}
    root, record = parse(html), {}
    if "metadata" in parts:
        record["metadata"] = metadata(root, url)
    if "links" in parts or "images" in parts:
        record["links"], record["images"] = [], []
        for node in root.walk():
            if node.tag == "a" and node.attrs.get("href"):
                record["links"].append(node.attrs["href"])
            elif node.tag == "img" and node.attrs.get("src"):
                record["images"].append(node.attrs["src"])
    if "link_density" in parts:
        record["link_density"] = link_density(root)
    if "markdown" in parts or "engine" in parts:
        short = capped(html, longest)
        if len(short) < len(html):
            root = parse(short)
        remove_furniture(root)
        prune_links(root)
        sanitize(root)
        record["markdown"], record["engine"] = extract(html, root, most_lines)
    return record


CLEAN = T.StructType([T.StructField("html", S), T.StructField("size", T.LongType())])


def clean_record(html: str | None, url: str | None) -> dict:
    """Another extractor: the cleaned HTML, and its length in characters."""
    from siltstream.html.clean import clean_html

    out = clean_html(html)
    return {"html": out, "size": len(out)}


def parse_pages(
    pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = (), extractor: Extractor = page_record, schema: T.StructType = PAGE,
    parts: tuple[str, ...] | None = None, longest: int | None = None, most_lines: int | None = None,
) -> DataFrame:
    """The columns ``keep`` and those of ``schema``, which ``extractor`` reads from each page.

    Of the engine's own extractor only the ``parts`` named are read, and paid for; its limits are ``page_record``'s.
    Gates belong before this: they are then pushed to the scan, and only pages that pass are parsed. Null and empty
    pages give an empty text with engine ``none``. Any other extractor of (html, url) can be given with its schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if extractor is page_record:
        parts = parts or PARTS
        extractor = partial(page_record, parts=parts, longest=longest, most_lines=most_lines)
        schema = T.StructType([PAGE[part] for part in parts])
    kept = spread(pages.select(*keep, F.col(html).alias("_html"), F.col(url).alias("_url")))
    out = T.StructType([*(kept.schema[c] for c in keep), *schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            records = [extractor(h, u) for h, u in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            columns = [pa.array([r[f.name] for r in records], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], out.names)

    return kept.mapInArrow(run, out)


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def rendered(items: DataFrame) -> DataFrame:
    """(item_id, url, html): delivered items as the pages they might have come from, for tables without HTML."""
    m = lambda name: _escaped(F.coalesce(F.col(f"metadata.{name}"), F.lit("")))

    def line(x: Column) -> Column:
        text = _escaped(F.trim(x))
        linked = F.regexp_replace(text, r"\[([^\[\]]*)\]\(([^()\s]*)\)", '<a href="$2">$1</a>')
        return (
            F.when(text == "", "")
            .when(text.rlike("^#{1,6} "), F.concat(F.lit("<h"), F.char_length(F.regexp_extract(text, "^(#+)", 1)).cast("string"), F.lit(">"), F.regexp_replace(linked, "^#+ ", ""), F.lit("</h"), F.char_length(F.regexp_extract(text, "^(#+)", 1)).cast("string"), F.lit(">")))
            .when(text.rlike(r"^[-*] "), F.concat(F.lit("<ul><li>"), F.regexp_replace(linked, r"^[-*] ", ""), F.lit("</li></ul>")))
            .otherwise(F.concat(F.lit("<p>"), linked, F.lit("</p>")))
        )

    body = F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), line), "\n")
    head = F.concat(
        F.lit("<title>"), m("title"), F.lit('</title><meta property="og:title" content="'), m("og_title"), F.lit('"><meta name="description" content="'), m("description"),
        F.lit('"><meta name="keywords" content="'), _escaped(F.coalesce(F.array_join("metadata.keywords", ", "), F.lit(""))), F.lit('"><meta name="author" content="'), m("author"),
        F.lit('"><script type="application/ld+json">'), F.coalesce("metadata.json_ld", F.lit("")), F.lit("</script>"),
    )
    html = F.concat(F.lit("<!doctype html><html><head>"), head, F.lit('</head><body><nav><a href="/">Home</a></nav><article>'), body, F.lit("</article><footer>end</footer></body></html>"))
    return items.select("item_id", "url", html.alias("html"))
