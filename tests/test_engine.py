import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from siltstream.engine import STATES, Cached, Engine
from siltstream.functions import markdown, text, urls
from siltstream.operators import activity, gating, mission, report, state, transport
from siltstream.operators.policies import Breaker

PAGES = [(f"https://h.test/{k}", 200, f"<title>Page {k}</title><p>page {k}</p><a href='/{k + 1}'>next</a>") for k in range(4)]
T0 = dt.datetime(2025, 3, 1, 12)


def _engine(spark, told=None):
    pages = spark.createDataFrame(PAGES, "url string, status int, html string")
    store = mission.seeded(spark.createDataFrame([("https://h.test/0",)], "url string"))
    return Engine(pages, store, on_state=told)


def test_run_and_views(spark):
    told = []
    engine = _engine(spark, lambda *change: told.append(change))
    done = engine.run()
    assert [t[0] for t in told] == ["running", "finalizing", "mission_complete"] and set(t[0] for t in told) <= set(STATES)
    assert done.items.count() == 4 and engine.get_stats()["completed"] == 4 and engine.get_stats()["failed"] == 1
    shown = engine.get_dashboard_state()
    assert (shown["state"], shown["total"], shown["percent"], shown["paused"]) == ("mission_complete", 5, 100.0, False)
    assert [r.url for r in engine.get_queue_status(2, 1).collect()] == ["https://h.test/1", "https://h.test/2"]
    errors = engine.get_error_list().collect()
    assert [(r.url, r.error_type, r.error_message) for r in errors] == [("https://h.test/4", "ProcessingError", "HTTP 404")]
    assert engine.get_logs("error").count() == 1 and engine.get_logs().count() == 5
    assert engine.store.filter("status <> 'pending' AND last_try IS NULL").count() == 0


def test_stop_and_go_on(spark):
    engine = _engine(spark)
    rounds = []
    between = engine._between
    engine._between = lambda store, n: (rounds.append(n), engine.stop() if n == 2 else None, between(store, n))[-1]
    engine.run()
    assert engine.status == "stopped" and engine.rounds == 2
    left = {r.url: r.status for r in engine.store.collect()}
    assert left == {"https://h.test/0": "completed", "https://h.test/1": "completed", "https://h.test/2": "pending"}
    # What was in progress when an engine was lost is pending in the next.
    lost = engine.store.withColumn("status", F.when(F.col("url").endswith("/2"), "in_progress").otherwise(F.col("status")))
    pages = spark.createDataFrame(PAGES, "url string, status int, html string")
    after = Engine(pages, lost)
    after.run()
    assert after.get_stats()["completed"] == 4


def test_pause_holds_the_next_round(spark):
    engine = _engine(spark)
    engine.pause()
    assert engine.is_paused() and engine.status == "paused"
    run = threading.Thread(target=engine.run, daemon=True)
    run.start()
    run.join(3)
    assert run.is_alive() and engine.rounds == 0
    engine.resume()
    run.join(120)
    assert not run.is_alive() and engine.get_stats()["completed"] == 4


def test_one_mission_a_site(spark, tmp_path):
    lock = state.MissionLock(str(tmp_path), "h.test")
    pages = spark.createDataFrame(PAGES[:1], "url string, status int, html string").withColumn("code", F.lit(1)).withColumn("allowed", F.lit("x"))
    store = mission.seeded(spark.createDataFrame([("https://h.test/9",)], "url string"))
    held = state.MissionLock(str(tmp_path), "h.test")
    assert held.acquire()
    with pytest.raises(RuntimeError):
        Engine(pages, store, lock=lock).run()
    assert held.release()
    engine = Engine(pages, store, lock=lock)
    assert engine.run().rounds == 3 and engine.get_stats()["failed"] == 1  # tried three times
    assert lock.acquire() and lock.release()


def test_config_within_bounds(spark):
    engine = _engine(spark)
    before = engine.get_config()
    assert engine.update_config(workers=11, request_delay=-1, timeout=4) == before
    assert engine.update_config(3, 250, 9, "browser") == {"workers": 3, "request_delay": 250, "timeout": 9, "mode": "browser"}
    with pytest.raises(ValueError):
        engine._change("sleeping")


def test_cached():
    now, calls = [0.0], []
    kept = Cached(lambda: calls.append(1) or {"n": len(calls)}, 5, lambda: now[0])
    assert kept() == kept() == {"n": 1}
    now[0] = 5.0
    assert kept() == {"n": 2}
    kept.forget()
    assert kept() == {"n": 3}


def test_assets_in_a_mission(spark):
    pages = spark.createDataFrame([("https://h.test/", 200, "<img src='/a.png'><img src='/b.png'>")], "url string, status int, html string")
    assets = spark.createDataFrame([("https://h.test/a.png", b"x"), ("https://h.test/b.png", None)], "url string, content binary")
    done = mission.run(pages, mission.seeded(spark.createDataFrame([("https://h.test/",)], "url string")), assets=assets)
    assert {(r.url[-5:], r.status, r.last_error) for r in done.store.filter("type = 'asset'").collect()} == {("a.png", "completed", None), ("b.png", "failed", "HTTP 404")}


ROWS = [
    (1, 1, "https://h.test/a", "T", "completed", None, "x", "webpage"), (2, 2, "https://h.test/b", "", "error", "HTTP 500", None, "webpage"),
    (3, 3, None, None, "error", None, None, "asset"), (4, 4, "https://h.test/d", None, "warning", "", "y", "asset"), (5, 5, "", None, None, None, None, None),
]
LOG = "seq int, at int, url string, title string, status string, error string, engine string, kind string"


def test_activity(spark):
    rows = spark.createDataFrame(ROWS, LOG)
    lines = [(r.seq, r.level, r.message, r.source) for r in activity.log_lines(rows).collect()]
    assert lines == [(5, "INFO", "", "engine"), (4, "WARNING", "warning: https://h.test/d", "y"), (3, "ERROR", "error", "engine"), (2, "ERROR", "HTTP 500: https://h.test/b", "engine"), (1, "INFO", "T: https://h.test/a", "x")]
    assert activity.log_lines(rows, 2, "error").count() == 0  # the limit comes before the level
    assert [r.seq for r in activity.search(activity.log_lines(rows), "H.TEST/A").collect()] == [1] and activity.search(activity.log_lines(rows), "").count() == 5
    assert [(r.url, r.error_message) for r in activity.error_list(rows).collect()] == [("", "Unknown error"), ("https://h.test/b", "HTTP 500")]
    assert activity.error_list(rows, 2).count() == 0 and activity.error_list(rows.limit(0)).count() == 0
    assert activity.mission_counters(rows).first().asDict() == {"pages_completed": 1, "pages_failed": 1, "assets_completed": 1, "assets_failed": 1, "error_count": 2}


def test_outcomes(spark):
    rows = [("a", 1, 503), ("a", 2, 200), ("a", 3, 200), ("b", 1, 500), ("b", 2, None), ("b", 3, 599), ("b", 4, 200), ("c", 1, 404), ("d", 1, 503), ("e", 1, 503), ("e", 2, 503)]
    df = spark.createDataFrame(rows, "request string, attempt int, status int")
    got = {r.request: (r.status, r.attempts, r.waited) for r in transport.outcomes(df).collect()}
    assert got == {"a": (200, 2, 1.0), "b": (504, 3, 3.0), "c": (404, 1, 0.0), "d": (503, 1, 0.0), "e": (503, 2, 1.0)}
    shut = {r.request: r.status for r in transport.outcomes(df, allowed=F.col("attempt") < 2).collect()}
    assert shut["a"] == shut["b"] == shut["e"] == 421 and shut["c"] == 404
    assert [(r.request, r.attempt, r.wait) for r in transport.retry_events(df).orderBy("request", "attempt").collect()] == [("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 2.0), ("d", 1, 1.0), ("e", 1, 1.0), ("e", 2, 2.0)]


def test_breaker_state_at_a_time(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    folded = spark.createDataFrame(
        [("a", at(0), True, "open"), ("a", at(1), False, "open"), ("a", at(3000), True, "closed"), ("b", at(0), True, "closed")],
        "site string, ts timestamp, allowed boolean, state string",
    )
    asked = spark.createDataFrame([("a", at(m)) for m in (-1, 0, 4, 5, 2000, 3000, 9000)] + [("b", at(1)), ("c", at(1)), (None, at(1))], "site string, asked timestamp")
    got = {(r.site, r.asked): r.state for r in transport.breaker_states(folded, asked, Breaker(), "site", "ts").collect()}
    assert [got["a", at(m)] for m in (-1, 0, 4, 5, 2000, 3000, 9000)] == ["closed", "open", "open", "half-open", "half-open", "closed", "closed"]
    assert got["b", at(1)] == got["c", at(1)] == got[None, at(1)] == "closed"


def test_pages_of_the_store_and_reset(spark):
    rows = [(f"https://h{k % 2}.test/{k}", "pending") for k in range(25)] + [(None, "pending"), ("https://h0.test/0", "failed")]
    store = spark.createDataFrame(rows, "url string, status string")
    pages = [tuple(r) for n in range(4) for r in state.page(store, 8, 8 * n).collect()]
    assert len(pages) == 27 and sorted(pages, key=str) == sorted(map(tuple, rows), key=str)
    assert state.of_domain(store, "h0.test").count() == 14 and state.reset_domain(store, "h0.test").count() == 13


def test_robots_with_a_time_to_live(spark):
    rows = [("o1", 200, "new", T0), ("o1", 200, "old", T0 - dt.timedelta(minutes=50)), ("o2", 200, "x", T0 - dt.timedelta(minutes=61)), ("o3", 200, "y", None)]
    robots = spark.createDataFrame(rows, "origin string, status int, body string, fetched_at timestamp")
    assert [(r.origin, r.body) for r in gating.fresh_robots(robots, F.lit(T0)).collect()] == [("o1", "new")]


def test_robots_rules(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /a/b\nDisallow: /a\nDisallow: /caf%C3%A9\nDisallow: /x?y\nDisallow:\n"
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse(body.splitlines())
    paths = ["/", "/a", "/a/b/c", "/ab", "/café/1", "/caf%c3%a9", "/x?y=1", "/x", "/z%zz", "", "/a%2Fb", "/~u"]
    df = spark.createDataFrame([(f"https://h.test{p}",) for p in paths], "url string")
    robots = spark.createDataFrame([("https://h.test", 200, body)], "origin string, status int, body string")
    for agent in ("*", "Other/2.0"):
        got = {r.url: r.allowed for r in gating.robots_gate(df, robots, agent).collect()}
        assert got == {u: parser.can_fetch(agent, u) for u in got}


def test_forms_and_fixed_scope(spark):
    df = spark.createDataFrame([(0,), (59,), (3_661,), (360_000,), (-5,), (None,)], "s long")
    assert [r[0] for r in df.select(text.clock_time("s")).collect()] == ["00:00:00", "00:00:59", "01:01:01", "100:00:00", "00:00:00", None]
    assert spark.range(1).select(text.time_of_day(F.lit(86_399))).first()[0] == "23:59:59"
    df = spark.createDataFrame([("https://h.test/a/", "https://h.test/a/b"), ("https://h.test/a/", "https://h.test/ab"), ("https://h.test/", "https://h.test/x")], "base string, url string")
    assert [r[0] for r in df.select(urls.in_scope("url", "base", "strict", strict_fixed=True)).collect()] == [True, False, True]


def test_report_totals_and_documents(spark):
    store = spark.createDataFrame([("failed", "e" * 90), ("failed", None), ("failed", None), ("completed", None), (None, None)], "status string, last_error string")
    got = {(r.section, r.name): r.value for r in report.mission_report(store).collect()}
    assert got == {("status", "failed"): 3, ("status", "completed"): 1, ("status", "(none)"): 1, ("total", "TOTAL"): 5, ("error", "Unknown"): 2, ("error", "e" * 80 + "..."): 1}
    batches = spark.createDataFrame([(k, k % 7) for k in range(2_500)], "n int, size int")
    totals = {r.n: r.total for r in report.running_total(batches, "size", "n").collect()}
    assert all(totals[k] == sum(j % 7 for j in range(k + 1)) for k in (0, 999, 1_000, 2_499)) and len(totals) == 2_500
    page = spark.createDataFrame([("https://h.test/a/b", "T", "# Head\n\n[x](c)", [(1, "Head", None)])], "url string, title string, md string, headers array<struct<level:int,text:string,id:string>>")
    out = page.select(markdown.document(F.struct("url", "title"), "md", "headers", "url")).first()[0]
    assert out.startswith('---\ntitle: T\nurl: "https://h.test/a/b"\n---\n\n# Head') and "[x](https://h.test/a/c)" in out and "- [Head](#head)" in out
