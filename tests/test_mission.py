from siltstream.functions import sql
from siltstream.operators import frontier, mission

PAGES = [
    ("https://h.example/", 200, "<title>Home</title><a href='/a'>a</a><a href='/b'>b</a><a href='/secret/x'>s</a><img src='/i.png'>"),
    ("https://h.example/a", 200, "<title>A</title><p>text of a</p><a href='/'>home</a><a href='/gone'>g</a><a href='https://o.example/'>o</a>"),
    ("https://h.example/b", 200, "<p>g-recaptcha</p>"),
    ("https://h.example/secret/x", 200, "<p>x</p>"),
]


def test_rounds_to_the_end(spark):
    pages = spark.createDataFrame([*PAGES, PAGES[0]], "url string, status int, html string")
    robots = spark.createDataFrame([("https://h.example", 200, "User-agent: *\nDisallow: /secret")], "origin string, status int, body string")
    done = mission.run(pages, mission.seeded(spark.createDataFrame([("https://h.example/",)], "url string")), robots)
    got = {r.url: (r.status, r.type, r.retries) for r in done.store.collect()}
    assert got == {
        "https://h.example/": ("completed", "webpage", 0), "https://h.example/a": ("completed", "webpage", 0), "https://h.example/b": ("failed", "webpage", 3),
        "https://h.example/secret/x": ("skipped_robots", "webpage", 0), "https://h.example/gone": ("failed", "webpage", 3), "https://h.example/i.png": ("pending", "asset", 0),
    }
    assert {(r.url, r.title) for r in done.items.collect()} == {("https://h.example/", "Home"), ("https://h.example/a", "A")}
    assert done.rounds == 5


def test_chains_longer_than_fifty_links(spark):
    name = "https://h.example/{}".format
    seeds = spark.createDataFrame([(name(0),)], "url string")
    graph = spark.createDataFrame([(name(k), name(k + 1)) for k in range(52)], "src string, dst string").coalesce(1)
    assert {r.url: r.depth for r in frontier.reach(graph, seeds).collect()} == {name(k): k for k in range(53)}
    pages = spark.createDataFrame([(name(k), 200, f"<p>page {k}</p>" + f"<a href='/{k + 1}'>next</a>" * (k < 51)) for k in range(52)], "url string, status int, html string").coalesce(1)
    done = mission.run(pages, mission.seeded(seeds))
    assert {(r.url, r.status) for r in done.store.collect()} == {(name(k), "completed") for k in range(52)}
    assert done.items.count() == 52 and done.rounds == 52


def test_nothing_to_do(spark):
    pages = spark.createDataFrame([], "url string, status int, html string")
    done = mission.run(pages, mission.seeded(spark.createDataFrame([], "url string")))
    assert done.rounds == 0 and done.store.count() == 0 and done.items.count() == 0


def test_sql_names(spark):
    sql.register(spark)
    assert spark.sql("SELECT slugify('Hola Mundo'), join_url('https://h.example/a', 'b'), normalize_url('https://h.example/ä')").collect()[0][0] == "hola-mundo"
    rows = spark.sql("SELECT * FROM page_links('<a href=/x>x</a><img src=y>')").collect()
    assert [(r.href, r.kind) for r in rows] == [("/x", "link"), ("y", "image")]
