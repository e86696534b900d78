"""Pages written by hand, with markup as it is found, and what must be read from each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import pages
from siltstream.plans.registry import query

PROSE = "The ferry leaves at nine and comes back at noon, unless the fog is too thick to see the other bank of the river."

# (name, HTML, title, kind of page, card, JSON-LD, headings, links, images, way of the text, Markdown)
SAMPLES = [
    (
        "article",
        f"""<!DOCTYPE html><HTML><head><title>Ferry times | Port News</title><META property='og:type' CONTENT=article><meta name="twitter:card" content="summary">
<script type="application/ld+json">{{broken</script><script type='application/ld+json'>{{"@type": "Trip"}}</script></head>
<body><nav><a href="/">Home</a><a href="/all">All</a></nav><h1>Ferry <em>times</em></h1><p>{PROSE}<p>See the <a href=/map?x=1&amp;y=2>map</a>.<img src="/ferry.png" alt="Ferry"></body></html>""",
        "Ferry times", "article", "summary", '{"@type": "Trip"}', "1:Ferry times", "/ /all /map?x=1&y=2", "/ferry.png", "markdown",
        # The title's text stays when its tag goes, as in the system that this re-expresses.
        f"Ferry times | Port News\n\n# Ferry *times*\n\n{PROSE}\n\nSee the [map](/map?x=1&y=2).![Ferry](/ferry.png)",
    ),
    ("list", f"<body><p>{PROSE}</p><ol start=3><li>Pay<li>Board<ul><li>bikes</ul></ol><footer>gone</footer>", "Documento", None, None, None, "", "", "", "markdown", f"{PROSE}\n\n3. Pay\n4. Board\n   - bikes"),
    ("table", f"<table><tr><th>Time<th>Fare<tr><td>9:00<td>2|3</table><p>{PROSE}</p><script>var x = '<p>no</p>'</script>", "Documento", None, None, None, "", "", "", "markdown", f"| Time | Fare |\n|---|---|\n| 9:00 | 2\\|3 |\n\n{PROSE}"),
    ("dense", f"<div><a href='/1'>a long list of links</a> <a href='/2'>and one more</a></div><p>{PROSE}</p>", "Documento", None, None, None, "", "/1 /2", "", "markdown", PROSE),
    ("dense with image", f"<div><a href='/1'>a long list of links</a> <img src=/i.gif></div><p>{PROSE}</p>", "Documento", None, None, None, "", "/1", "/i.gif", "markdown", f"[a long list of links](/1) ![](/i.gif)\n\n{PROSE}"),
    ("plain", "<p>A page of no more than a few words, which is too short for Markdown.</p>", "Documento", None, None, None, "", "", "", "plain", "A page of no more than a few words, which is too short for Markdown."),
    ("lines", "<div><b>2,50</b></div><div>sold out</div>", "Documento", None, None, None, "", "", "", "lines", "2,50\nsold out"),
    ("code", f"<h2 id=run>Run</h2><pre>a &lt; b\n  c</pre><blockquote><p>{PROSE}</blockquote>", "Documento", None, None, None, "2:Run", "", "", "markdown", f"## Run\n\n```\na < b\n  c\n```\n\n> {PROSE}"),
    ("unsafe", f"<p onclick='x()'>{PROSE} <a href='java\nscript:x()'>here</a></p><!-- <p>comment</p> --><iframe src=/f></iframe>", "Documento", None, None, None, "", "java\nscript:x()", "", "markdown", f"{PROSE} here"),
    ("misnested", f"<p><b>{PROSE}</p></b></i><div class='x ads'>gone</div><p id=menu>gone</p><p>1 < 2</p>", "Documento", None, None, None, "", "", "", "markdown", f"**{PROSE}**\n\n1 < 2"),
    ("empty", "", None, None, None, None, None, "", "", "none", ""),
]
NAMES = ("name", "title", "og_type", "twitter_card", "json_ld", "headings", "links", "images", "engine", "markdown")


def _values() -> str:
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(literal(v) for v in (row[0], *row[2:])) + ")" for row in SAMPLES)


@query(f"SELECT * FROM (VALUES {_values()}) AS t({', '.join(NAMES)})")
def page_samples(spark: SparkSession, folder: str) -> DataFrame:
    """What the page pass reads from hand-written pages."""
    html = spark.createDataFrame([(row[0], row[1], "https://port.test/x") for row in SAMPLES], "name string, html string, url string")
    m = "metadata."
    headings = F.array_join(F.transform(m + "headers", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"])), " ")
    return pages.parse_pages(html, keep=("name",)).select(
        "name", m + "title", m + "og_type", m + "twitter_card", m + "json_ld", headings.alias("headings"), F.array_join("links", " ").alias("links"), F.array_join("images", " ").alias("images"), "engine", "markdown",
    )
