from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstream.functions import markdown as M
from siltstream.functions import text as X

HEADER = "array<struct<level:int,text:string,id:string>>"


def one(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression).collect()[0][0]


def test_cleaning(spark):
    assert one(spark, X.clean_text("t"), "t string", " a\n\n\n\nb  ") == "a\n\nb"
    assert one(spark, X.clean_text("t"), "t string", None) is None
    assert one(spark, X.repair_text("t"), "t string", "cafÃ© â€œxâ€\x9d") is not None
    assert X.repaired("cafÃ©") == "café" and X.repaired("café") == "café" and X.repaired(None) is None
    assert X.repaired("Ã\nplain") == "Ã\nplain"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aéüñ \n", max_size=40))
def test_repair_undoes_a_misreading(text):
    assert X.repaired(text) == text
    spoiled = text.encode("utf-8").decode("cp1252", errors="ignore")
    if spoiled.encode("cp1252", errors="ignore") == text.encode("utf-8"):
        assert X.repaired(spoiled) in (text, spoiled)


def test_titles_keywords_anchors(spark):
    assert one(spark, X.title_clean("a", "b"), "a string, b string", "", "Name - Site | x") == "Name"
    assert one(spark, X.title_clean("a", "b"), "a string, b string", None, None) == "Documento"
    assert one(spark, X.keywords("t"), "t string", " a, ,b ,") == ["a", "b"]
    for text, want in (("Hello  World!", "hello-world"), ("¡!", "section"), ("a b", "a-b"), ("--x--", "x")):
        assert one(spark, X.anchor_slug("t"), "t string", text) == want


def test_formats(spark):
    for n, want in ((0, "0 B"), (512, "512.00 B"), (1536, "1.50 KB"), (5 * 1024**3, "5.00 GB"), (3 * 1024**4, "3.00 TB")):
        assert one(spark, X.human_size("n"), "n bigint", n) == want
    for n, want in ((-1, "∞"), (59, "0:59"), (61, "1:01"), (3661, "1:01:01")):
        assert one(spark, X.elapsed("n"), "n bigint", n) == want
    for n, want in ((5, "5s ago"), (300, "5m ago"), (7300, "2h ago")):
        assert one(spark, X.ago("n"), "n bigint", n) == want
    for n, want in ((10.0, "ok"), (60.0, "warning"), (81.0, "critical"), (None, None)):
        assert one(spark, X.band("n", 50, 80), "n double", n) == want
    assert one(spark, X.ratio_percent("a", "b"), "a bigint, b bigint", 1, 0) == 0.0
    assert one(spark, X.transport_wait("n"), "n int", 10) == 60.0
    for n, want in ((1, "small"), (20 * 2**20, "medium"), (60 * 2**20, "large")):
        assert one(spark, X.size_tier("n"), "n bigint", n) == want
    assert one(spark, X.shortened("t", 3), "t string", "abcdef") == "abc..."


def test_toc(spark):
    headers = [(1, "Intro", "intro"), (2, "Setup Guide", None), (5, "Deep", None), (2, None, "")]
    assert one(spark, M.table_of_contents("h"), f"h {HEADER}", headers) == "## Tabla de Contenidos\n\n- [Intro](#intro)\n  - [Setup Guide](#setup-guide)\n  - [](#section)\n"
    assert one(spark, M.table_of_contents("h"), f"h {HEADER}", None) == ""
    assert one(spark, M.table_of_contents("h"), f"h {HEADER}", [(6, "x", None)]) == ""


def test_links():
    md = "[docs](/docs) and [home](../index.html) ![i](./a.png) [x](mailto:a@b.example) [y](#z)"
    base = "https://example.com/guides/intro/"
    assert M.with_absolute_links(md, base) == "[docs](https://example.com/docs) and [home](https://example.com/index.html) ![i](https://example.com/guides/a.png) [x](mailto:a@b.example) [y](#z)"
    assert M.resolve_from("https://h.example", "../../x") == "https://h.example/x"
    assert M.with_absolute_links(None, base) is None and M.with_absolute_links(md, None) == md


def test_enhanced(spark):
    df = spark.createDataFrame([("# T\n\nText [a](/b)\nmore", [(1, "T", None)], "https://h.example/p")], f"m string, h {HEADER}, u string")
    got = df.select(M.enhanced("m", "h", "u")).collect()[0][0]
    assert got == "# T\n\n\n## Tabla de Contenidos\n\n- [T](#t)\n\n\nText [a](https://h.example/b)\nmore"


def test_frontmatter():
    import yaml

    row = {"url": "https://x.example", "title": "A: b", "author": "", "keywords": ["k", "yes"], "og_image": None, "headers": [1]}
    text = M.frontmatter_of(row)
    assert text.startswith("---\n") and text.endswith("---\n\n")
    assert yaml.safe_load(text.split("---")[1]) == {"url": "https://x.example", "title": "A: b", "author": "", "keywords": ["k", "yes"]}


def test_special_urls(spark):
    for url, want in (("http://x", True), (" #a", True), ("", True), ("tel:1", True), ("a/b", False), ("/x", False)):
        assert one(spark, M.is_special_url("u"), "u string", url) == want
    assert F is not None
