import datetime as dt

from pyspark.sql import functions as F

from siltstream.operators import assets, frontier, gating, report, state

STORE = "url string, status string, type string, retries int, last_error string, last_try timestamp, discovered_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def store(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], STORE)


def test_insert_ignore(spark):
    old = store(spark, ("https://h.example/a", "completed", "webpage", 2))
    new = spark.createDataFrame([("https://h.example/a", "pending", 1), ("https://h.example/b", "first", 1), ("https://h.example/b", "second", 2), ("nonsense", "pending", 1), (None, "pending", 1)], "url string, status string, seq int")
    after, refused = state.insert_ignore(old, new, F.col("seq"))
    got = {r.url: r.status for r in after.collect()}
    assert got == {"https://h.example/a": "completed", "https://h.example/b": "first"} and after.count() == 2
    assert {r.url for r in refused.collect()} == {"nonsense", None}
    empty, _ = state.insert_ignore(old, new.limit(0), F.col("seq"))
    assert empty.count() == 1


def test_merge_and_retries(spark):
    old = store(spark, ("u1", "failed", "webpage", 1, "x", T0, T0), ("u2", "pending", None, None, None, None, None))
    changes = spark.createDataFrame([("u1", "failed", "e" * 600, T0, 1), ("u1", "completed", None, T0, 2), ("u2", "failed", "e" * 600, T0, 1), ("nobody", "failed", "x", T0, 1)], "url string, status string, error string, at timestamp, seq int")
    got = {r.url: r for r in state.merge_status(old, changes).collect()}
    assert len(got) == 2 and got["u1"].status == "completed" and got["u1"].last_error is None and len(got["u2"].last_error) == 500
    more = spark.createDataFrame([("u2",), ("u2",), ("nobody",)], "url string")
    assert {r.url: r.retries for r in state.add_retries(old, more).collect()} == {"u1": 1, "u2": 2}
    next_ = {r.url: r for r in state.next_tries(store(spark, ("a", "failed", "webpage", 0, None, T0), ("b", "failed", "webpage", 2, None, T0))).collect()}
    assert next_["a"].again and next_["a"].next_try == T0 + dt.timedelta(seconds=2) and not next_["b"].again and next_["b"].next_try is None


def test_pending_latest_reset(spark):
    rows = [("a", "pending", "webpage", 9), ("b", "failed", "webpage", 2), ("c", "failed", "webpage", 3), ("d", "completed", "webpage"), ("e", "pending", "asset"), ("f", "failed", "webpage")]
    assert {r.url for r in state.pending(store(spark, *rows), "webpage").collect()} == {"a", "b", "f"}
    twice = store(spark, ("a", "pending", "webpage", 0, None, None, T0), ("a", "completed", "webpage", 0, None, T0 + dt.timedelta(1), T0), ("a", "completed", "webpage", 0, None, T0 + dt.timedelta(1), T0))
    assert [r.status for r in state.latest(twice, "url", F.coalesce("last_try", "discovered_at")).collect()] == ["completed"]
    sites = store(spark, ("https://x.example/1", "pending"), ("https://y.example/1", "pending"))
    assert [r.url for r in state.reset_domain(sites, "x.example").collect()] == ["https://y.example/1"]


def test_lock(tmp_path):
    a, b = state.MissionLock(str(tmp_path), "h.example"), state.MissionLock(str(tmp_path), "h.example")
    assert a.acquire() and not b.acquire()
    assert a.release() and not a.release() and b.acquire()


def test_reports(spark):
    rows = store(spark, ("a", "completed"), ("b", "failed", "webpage", 1, "Network Error"), ("c", "failed", "asset", None, "Network Error"), ("d", "failed", None, None, None), ("e", "failed", None, 0, "Unknown"))
    assert {r.status: r["count"] for r in report.status_totals(rows).collect()} == {"completed": 1, "failed": 4, "TOTAL": 5}
    assert [(r.error, r["count"], r.missing) for r in report.top_errors(rows, 3).collect()] == [("Network Error", 2, False), ("Unknown", 1, False), ("Unknown", 1, True)]
    assert report.stats_map(rows).collect()[0].asDict() == {"pending": 0, "completed": 1, "failed": 4, "skipped_robots": 0, "total_webpages": 1, "total_assets": 1, "total": 5}
    none = rows.limit(0)
    assert report.stats_map(none).collect()[0].total == 0 and report.progress(none, F.col("status") == "completed").collect()[0].percent == 0.0
    assert report.status_totals(none).count() <= 1


def series(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "k string, at int, n double")


def trend_by_hand(values):
    n = len(values)
    if n < 2:
        return "flat"
    recent = values[-min(10, n) :]
    older = values[n - 20 : n - 10] if n >= 20 else values[: n // 2]
    a, b = sum(recent) / len(recent), sum(older) / len(older)
    return "up" if a > 1.1 * b else "down" if a < 0.9 * b else "flat"


def test_trend_and_rolling(spark):
    values = [1, 1, 3, 2, 9, 9, 9, 1, 1, 1, 1, 5, 5, 5, 5, 0, 0, 0, 0, 0, 0, 8, 8, 8, 1, 1, 1, 1, 1, 1, 1]
    got = [r.trend for r in report.trend(series(spark, values), ["k"]).orderBy("at").collect()]
    assert got == [trend_by_hand([float(v) for v in values[: i + 1]]) for i in range(len(values))]
    last = report.rolling(series(spark, range(100)), ["k"]).orderBy("at").collect()[-1]
    assert last["mean"] == sum(range(40, 100)) / 60 and last["most"] == 99


def test_sparkline(spark):
    row = report.sparkline(series(spark, [0, 4, 8]), ["k"]).collect()[0]
    assert row.levels == "0,4,8" and row.line == " ▄█"
    assert report.sparkline(series(spark, [0, 0]), ["k"]).collect()[0].levels == "0,0"


def test_last_and_first(spark):
    rows = spark.createDataFrame([(i, f"u{i % 3}") for i in range(20)], "seq int, url string")
    assert [r.seq for r in report.last_n(rows, 3, "seq").collect()] == [19, 18, 17]
    assert {r.url: r.seq for r in report.first_of_each(report.last_n(rows, 6, "seq"), "url", "seq").collect()} == {"u2": 14, "u0": 15, "u1": 16}


def test_challenges_and_responses(spark):
    rows = [("x G-RECAPTCHA y", "recaptcha"), ("Checking your browser before accessing", "cloudflare_iuam"), ("captcha hcaptcha.com", "hcaptcha"), ("verify you are human", "generic_captcha"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "html string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", gating.challenge("html")).collect())
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (200, 500, 403, 404, None)], "s int").select(gating.response_class("s")).collect()]
    assert got == ["ok", "empty", "blocked", "error", "error"]
    raw = spark.createDataFrame([(bytearray(b"a\xffb"), bytearray(b"x")), (bytearray(b""), bytearray(b"body"))], "r binary, b binary")
    assert [r[0] for r in raw.select(gating.decoded("r", "b")).collect()] == ["a�b", "body"]


def test_robots(spark):
    pages = spark.createDataFrame([("https://a.example/private/x",), ("https://a.example/x",), ("https://b.example/x",), ("https://c.example/x",), (None,)], "url string")
    robots = spark.createDataFrame([("https://a.example", 200, "User-agent: *\nDisallow: /private"), ("https://b.example", 403, None), ("https://d.example", 404, None)], "origin string, status int, body string")
    got = {r.url: r.allowed for r in gating.robots_gate(pages, robots).collect()}
    assert got == {"https://a.example/private/x": False, "https://a.example/x": True, "https://b.example/x": False, "https://c.example/x": True, None: False}


def test_frontier(spark):
    html = "<a href='/page#section'>x</a><a href='/page'>y</a><a href='style.css'>n</a><a href='https://o.example/'>o</a><img src='/img.png'>"
    pages = spark.createDataFrame([("https://h.example/docs/", html), ("https://h.example/empty", ""), (None, None)], "url string, html string")
    found = frontier.triage(frontier.edges(pages, "url", frontier.html_links("html")))
    assert {(r.url, r.kind) for r in found.collect()} == {("https://h.example/page", "webpage"), ("https://h.example/img.png", "asset")}
    known = spark.createDataFrame([("https://h.example/page",)], "url string")
    fresh = frontier.new_urls(found, known)
    assert [r.url for r in fresh.collect()] == ["https://h.example/img.png"]
    assert "LeftAnti" in fresh._jdf.queryExecution().optimizedPlan().toString()


def test_reach_on_cycles(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert {r.url: r.depth for r in frontier.reach(graph, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert frontier.reach(graph.limit(0), seeds).count() == 1


def test_assets(spark):
    rows = [("https://h.example/Bild Ä.PNG", b"x"), ("https://h.example/d.pdf", b"x"), ("https://h.example/r.md", b"# hi\xff"), ("https://h.example/plain", None)]
    got = {r.url.rsplit("/", 1)[1]: r for r in assets.routed(spark.createDataFrame([(u, bytearray(b) if b is not None else None) for u, b in rows], "url string, content binary")).collect()}
    assert got["Bild Ä.PNG"].filename == "bild-a.png" and got["Bild Ä.PNG"].folder == "images"
    assert got["d.pdf"].folder == "docs" and got["d.pdf"].conversion_error and got["d.pdf"].strategy == "direct"
    assert got["r.md"].markdown.startswith("---\nurl: https://h.example/r.md") and got["r.md"].markdown.endswith("# hi�")
    assert got["plain"].extension == "" and got["plain"].markdown is None
