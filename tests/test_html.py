from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstream.html.clean import capped, clean_html, link_density
from siltstream.html.convert import extract
from siltstream.html.dom import parse, serialize
from siltstream.html.meta import metadata
from siltstream.operators.pages import page_record, parse_pages

FULL = """<!doctype html><html lang="en"><head><title>Night train diary | Rail Post</title>
<meta content="The night train to Varna" property="og:title"><meta property='og:site_name' content='Rail Post'><META NAME=author CONTENT="I. Petrova">
<meta property="og:description" content="Eleven hours, one dining car &amp; two borders"><meta property="og:image" content="/train.webp"><meta property="og:type" content="profile">
<meta name="description" content="A diary"><meta name="keywords" content=" rail ,night train,, borders"><meta name="date" content="2024-05-02">
<meta name="twitter:card" content="player"><meta name="twitter:site" content="@railpost"><meta name="twitter:title" content="Varna by night">
<script type="application/ld+json">{"@type": "Trip", </script><script type="application/ld+json"> ["TrainTrip", 11] </script></head>
<body><h1>Boarding</h1><p>We left at nine.<h2 id=dining>The dining car</h2><h4> </h4><h5>Two <em>borders</em></h5></body></html>"""


def test_static_furniture_goes():
    html = "".join(f"<{t}>gone</{t}>" for t in ("script", "style", "iframe", "svg", "form", "footer", "header", "nav")) + "<div>Stay</div><div class='a ads'>gone</div><p id=menu>gone</p>"
    out = clean_html(html)
    assert "Stay" in out and "gone" not in out


def test_density():
    links = "<ul>" + "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(5)) + "</ul>"
    assert "link number" not in clean_html(links + "<p>text</p>")
    assert "link number" in clean_html(links.replace("<li>", "<li><img src='x'>") + "<p>text</p>")
    assert "tiny" in clean_html("<div><a href=x>tiny</a></div>")
    assert link_density(parse("<div><a>ab</a>cd</div>")) == 2 / 5


def test_sanitizing():
    out = clean_html("<p onclick=x><a href='javascript:alert(1)'>a</a><a href='/b' style=y>b</a><blink>c</blink><img src='data:x' alt=z></p>")
    assert "onclick" not in out and "javascript" not in out and "style" not in out and "blink" not in out and "data:" not in out
    assert 'href="/b"' in out and "c" in out and "noopener" in out


def test_traps():
    out = clean_html('<script>var t="</p>"</script><p>a<p>b<b>never closed<div>c</div>')
    assert "var t" not in out and all(x in out for x in ("a", "b", "c"))
    assert clean_html("") == "" and clean_html(None) == ""
    assert "é" in clean_html("<p>&eacute;&amp;</p>") and "&amp;" in clean_html("<p>&amp;</p>")
    assert len(capped("<p>" + "x" * 100 + "</p>" + "y" * 5, 108)) <= 108


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abpdiv li\"'=&;!- \n", max_size=80))
def test_any_text_parses_and_cleaning_is_stable(html):
    serialize(parse(html))
    once = clean_html(html)
    assert "<script" not in once
    clean_html(once)


def test_markdown_ways():
    article = "<h1>Title here</h1>" + "<p>One paragraph with <b>bold</b>, <i>it</i> and a <a href='/x'>link</a>.</p>" * 3 + "<ul><li>a<ul><li>b</li></ul></li></ul><pre>x = 1</pre><blockquote>q</blockquote><hr><table><tr><th>h</th></tr><tr><td>v|w</td></tr></table>"
    text, way = extract(article)
    assert way == "markdown" and "# Title here" in text and "**bold**" in text and "[link](/x)" in text and "- a\n  - b" in text and "```\nx = 1\n```" in text and "> q" in text and "| h |" in text
    assert extract("<div><div>$29.99</div></div>") == ("$29.99", "lines")
    assert extract("<p>" + "word " * 15 + "</p>")[1] == "plain"
    assert extract("") == ("", "none") and extract(None) == ("", "none")
    for page in ("Hi", "42", "&lt;script&gt;", "日本語"):
        assert extract(page)[0] and extract(page)[1] != "none"
    assert extract("<b><p>x</b></i></p>" * 30)[0]


def test_metadata():
    m = metadata(parse(FULL), "https://h.example/x")
    assert m["title"] == "The night train to Varna" and m["sitename"] == "Rail Post" and m["keywords"] == ["rail", "night train", "borders"]
    assert (m["author"], m["date"], m["description"]) == ("I. Petrova", "2024-05-02", "A diary")
    assert m["og_description"] == "Eleven hours, one dining car & two borders" and m["og_image"] == "/train.webp" and m["og_type"] == "profile"
    assert (m["twitter_card"], m["twitter_site"], m["twitter_title"]) == ("player", "@railpost", "Varna by night")
    assert m["json_ld"] == '["TrainTrip", 11]'
    assert m["headers"] == [{"level": 1, "text": "Boarding", "id": None}, {"level": 2, "text": "The dining car", "id": "dining"}, {"level": 5, "text": "Two borders", "id": None}]
    bare = metadata(parse("<p>x</p>"), "https://h.example/x")
    assert (bare["title"], bare["author"], bare["date"], bare["sitename"], bare["json_ld"]) == ("Documento", "Desconocido", "N/A", "h.example", None)


def test_only_the_text_of_a_long_page_is_capped():
    from siltstream.html import clean

    html = "<a href='/first'>first</a><p>" + "long text. " * 500_000 + "</p><h2>Late</h2><a href='/last'>last</a><img src='/last.png'><script type='application/ld+json'>{}</script>"
    assert len(html) > clean.LONGEST_HTML
    record = page_record(html, "u", longest=clean.LONGEST_HTML)
    assert record["links"] == ["/first", "/last"] and record["images"] == ["/last.png"]
    assert record["metadata"]["headers"] == [{"level": 2, "text": "Late", "id": None}] and record["metadata"]["json_ld"] == "{}"
    assert record["link_density"] == link_density(parse(html))
    assert "/first" in record["markdown"] and "Late" not in record["markdown"] and len(record["markdown"]) <= clean.LONGEST_HTML
    assert "## Late" in page_record(html, "u")["markdown"]  # without a limit the whole page is read


def test_lines_are_not_limited_unless_asked():
    html = "<nav>menu</nav>" + "".join(f"<svg></svg><b>{k % 7}</b>" for k in range(0))
    assert extract(html)[0] == ""
    tree = parse("".join(f"<i>{k}</i><wbr>" for k in range(20)))
    assert extract("x", tree, 5)[0].count("\n") == 4 and extract("x", tree)[0].count("\n") == 19


def test_deep_and_flat_pages_take_linear_time():
    import time

    deep = "<div>" * 1_900 + "<b>" * 50 + "core text that is long enough to be seen as the page, " * 3 + "</b>" * 50 + "</div>" * 1_900
    flat = "<div>" + "<blink>x</blink> " * 60_000 + "</div>"
    lists = "<ul><li>a " * 300 + "end of the nested lists, which are many levels deep" + "</li></ul>" * 300
    began = time.time()
    assert "core text" in extract(deep)[0] and extract(flat)[0].count("x") == 60_000 and "end of the nested" in extract(lists)[0]
    assert time.time() - began < 8


def test_tokens():
    assert serialize(parse("a<b>c<!-- <p>no</p> -->d</b>")) == "a<b>cd</b>"
    assert serialize(parse("<a title='x>y' href=/z/>t</a>")) == '<a title="x&gt;y" href="/z/">t</a>'
    assert serialize(parse("1 < 2 && 3 > 2 <br/>")) == "1 &lt; 2 &amp;&amp; 3 &gt; 2 <br>"
    assert parse('<p title="never closed>text').text() == "text"  # a quote left open does not swallow the page
    assert parse("<SCRIPT>if (a</b>) '</p>'</Script >x").text() == "x"
    assert parse("<script>never closed <p>x</p>").text() == ""


def test_parts_of_a_page():
    for part in ("metadata", "markdown", "links", "images", "link_density"):
        whole, own = page_record(FULL, "u"), page_record(FULL, "u", (part,))
        assert own[part] == whole[part]
        assert page_record(None, "u", (part,)) == {part: page_record(None, "u")[part]}


def test_page_pass(spark):
    rows = [(1, "https://h.example/", FULL), (2, None, None), (3, "https://h.example/", ""), (4, "u", "<p>" + "long text. " * 20_000 + "</p>")]
    df = spark.createDataFrame(rows, "n int, url string, html string")
    out = {r.n: r for r in parse_pages(df, keep=("n",)).collect()}
    assert out[1].metadata.title == "The night train to Varna" and out[2].engine == "none" and out[3].markdown == "" and len(out[4].markdown) > 200_000
    assert parse_pages(df.limit(0), keep=("n",)).count() == 0
    assert page_record("<a href='/other'>o</a><img src='/img.png'>", "u")["links"] == ["/other"]


def test_pages_are_parsed_once_and_gates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "u", "<p>x</p>", 200)], "n int, url string, html string, status int").write.parquet(path)
    gated = spark.read.parquet(path).filter("status = 200")
    plan = parse_pages(gated, keep=("n",)).select("markdown", "engine", "metadata.title").filter("engine <> 'none'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EqualTo(status,200)" in plan
    assert F is not None
