import datetime as dt
import time
import gzip

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from siltstream.operators.policies import Breaker, Throttle, fold_in_memory
from siltstream.sources import files, sinks
from siltstream.sources.tables import table
from siltstream.streaming import policies as streams

T0 = dt.datetime(2025, 1, 1)


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("plain\n")
    (tmp_path / "b.md.gz").write_bytes(gzip.compress("gezippt é".encode()))
    (tmp_path / "c.md.zst").write_bytes(zstandard.ZstdCompressor().compress(b"zst \xff"))
    got = {r.file.rsplit("/", 1)[1]: r.text for r in files.compressed_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "plain\n", "b.md.gz": "gezippt é", "c.md.zst": "zst �"}
    assert {r.tier for r in files.file_tiers(spark, str(tmp_path)).collect()} == {"small"}
    assert files.folder_size(spark, str(tmp_path)).collect()[0].files == 3
    assert [r.value for r in files.lines(spark, str(tmp_path / "a.md")).collect()] == ["plain"]
    assert files.whole_texts(spark, str(tmp_path / "b.md.gz")).collect()[0].text == "gezippt é"
    doubled = files.process_chunks(spark.range(3), lambda b: pa.RecordBatch.from_arrays([pa.compute.multiply(b.column(0), 2)], ["x"]), "x bigint")
    assert sorted(r.x for r in doubled.collect()) == [0, 2, 4]


def test_tables_read_only_what_is_asked(spark, tables):
    plan = table(spark, tables, "documents", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_validated_sink(spark, tmp_path):
    rows = [("u", "c", "d", "x"), (None, "c", "d", "x"), ("u", None, None, None)]
    items = spark.createDataFrame(rows, "url string, content string, domain string, title string")
    for _ in range(2):
        assert sinks.write_items(items, str(tmp_path)) == {"items": 1, "failed": 2}
    assert spark.read.json(f"{tmp_path}/items").count() == 2
    failed = {r.validation_error for r in spark.read.json(f"{tmp_path}/failed").collect()}
    assert failed == {"url: required", "content: required; domain: required"}
    valid, bad = sinks.split_valid(items.limit(0))
    assert valid.count() == 0 and bad.count() == 0


def test_page_rules(spark):
    rows = [("https://x", "T", "a.md.zst"), ("ftp://x", " ", "a.txt")]
    df = spark.createDataFrame(rows, "url string, title string, content_md_path string")
    got = [list(r[0]) for r in df.select(sinks.validation_errors((), sinks.page_input_rules())).collect()]
    assert got == [[], ["url: invalid", "title: invalid", "content_md_path: invalid"]]


def test_compression_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("a-b", "https://h.example/a/b", "text é " * 50), ("a-b", "https://h.example/a-b", "other"), ("c", "https://h.example/c", None)], "name string, url string, text string")
    for codec, ending in sinks.ENDINGS.items():
        out = sinks.packed_pages(pages, "url", "text", codec).collect()
        assert {files.unpacked("x" + ending, bytes(r.data)) for r in out} == {"text é " * 50, "other", ""}
        sinks.export_pages(pages, "name", "text", str(tmp_path / codec), codec)
        assert len(list((tmp_path / codec).iterdir())) == 3


def _stream(spark, tmp_path, rows, schema):
    source = str(tmp_path / "in")
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        assert i >= 0
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def _run(df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()


def test_streamed_breaker_equals_the_loop(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=i), i % 4 == 3) for i in range(24)]
    _run(streams.fold_stream(_stream(spark, tmp_path, rows, "domain string, ts timestamp, ok boolean"), Breaker(2, 5_000_000), "domain", "ts", "ok"), "breaker", tmp_path)
    got = [(r.allowed, r.state, r.failures) for r in spark.table("breaker").orderBy("at").collect()]
    base = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    assert got == fold_in_memory(Breaker(2, 5_000_000), [(base + i * 1_000_000, i % 4 == 3) for i in range(24)])


def test_streamed_throttle(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(milliseconds=40 * i)) for i in range(20)]
    _run(streams.fold_stream(_stream(spark, tmp_path, rows, "kind string, ts timestamp"), Throttle(100_000), "kind", "ts"), "throttled", tmp_path)
    assert [r.kept for r in spark.table("throttled").orderBy("at").collect()] == [r[0] for r in fold_in_memory(Throttle(100_000), [(40_000 * i, None) for i in range(20)])]


def test_seen_once_within_the_watermark(spark, tmp_path):
    rows = [("u1", T0), ("u1", T0 + dt.timedelta(minutes=5)), ("u2", T0), ("u1", T0 + dt.timedelta(minutes=9))]
    _run(streams.first_seen(_stream(spark, tmp_path, rows, "url string, ts timestamp"), "url", "ts"), "seen", tmp_path)
    assert sorted(r.url for r in spark.table("seen").collect()) == ["u1", "u2"]


def test_speed_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(milliseconds=300 * i),) for i in range(10)] + [(T0 + dt.timedelta(minutes=5),)]
    _run(streams.speed_stream(_stream(spark, tmp_path, rows, "ts timestamp"), "ts"), "speed", tmp_path)
    assert sum(r.n for r in spark.table("speed").collect()) >= 10


def test_store_sink(spark, tmp_path):
    store = spark.createDataFrame([("u", "pending", None, 0, None, None, None)], "url string, status string, type string, retries int, last_error string, last_try timestamp, discovered_at timestamp")
    sink = streams.StoreSink(store, str(tmp_path))
    changes = spark.createDataFrame([("u", "completed", None, T0, 1)], "url string, status string, error string, at timestamp, seq int")
    sink(changes, 0)
    sink(changes.withColumn("status", F.lit("failed")), 0)  # the same batch again changes nothing
    assert [r.status for r in sink.store.collect()] == ["completed"]


def test_store_sink_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.StoreSink, "COMPACT", 3)
    schema = "url string, status string, type string, retries int, last_error string, last_try timestamp, discovered_at timestamp"
    store = spark.createDataFrame([(f"u{k}", "pending", "webpage", 0, None, None, None) for k in range(8)], schema)
    change = lambda k, status: spark.createDataFrame([(f"u{k}", status, None, T0, 5), (f"u{k}", "in_progress", None, T0, 1)], "url string, status string, error string, at timestamp, seq int")
    for k in range(8):
        # Each batch meets a new sink, which is given the old store again.
        streams.StoreSink(store, str(tmp_path))(change(k, "completed"), k)
    sink = streams.StoreSink(store, str(tmp_path))
    sink(change(0, "failed"), 7)
    assert {(r.url, r.status) for r in sink.store.collect()} == {(f"u{k}", "completed") for k in range(8)}
    sink(change(0, "failed"), 8)
    assert {r.status for r in streams.StoreSink(store, str(tmp_path)).store.filter("url = 'u0'").collect()} == {"failed"}
    assert sink.state["base"].endswith("base-9") and sink.state["changes"] == []


def test_idle_state_goes(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "domain string, ts timestamp, ok boolean"
    for minute in (0, 100, 200):
        # Two failures at the start and at the end; another site's event in between moves the watermark on.
        rows = [("b", T0 + dt.timedelta(minutes=minute), True)] if minute == 100 else [("a", T0 + dt.timedelta(minutes=minute, seconds=k), False) for k in (0, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    _run(streams.fold_stream(stream, Breaker(5, 1_000_000), "domain", "ts", "ok", idle=1_800, late="1 minute"), "idle", tmp_path)
    assert [r.failures for r in spark.table("idle").filter("key = 'a'").orderBy("at").collect()] == [1, 2, 1, 2]


def test_item_sink(spark, tmp_path):
    from siltstream.streaming.items import ItemSink

    rows = [(f"https://h.test/{k}", f"text {k}" if k % 3 else None, "h.test") for k in range(12)]
    told = []
    schema = "url string, content string, domain string"
    items = _stream(spark, tmp_path, rows, schema)
    sink = ItemSink(str(tmp_path / "out"), rules={"url": F.col("url").startswith("https")}, on_flush=lambda n, c: told.append((n, c))).start(items, str(tmp_path / "cp"), 0.1)
    sink.flush()
    assert spark.read.json(str(tmp_path / "out" / "items")).count() == 8
    assert sink.close() == {"written": 8, "failed": 4, "flushes": 2} and sum(c["items"] for _, c in told) == 8
    failed = spark.read.json(str(tmp_path / "out" / "failed"))
    assert failed.count() == 4 and {r.validation_error for r in failed.collect()} == {"content: required"}
    # Another sink goes on from the checkpoint, and a batch that comes again replaces itself.
    spark.createDataFrame([("https://h.test/new", "t", "h.test"), ("ftp://x", "t", "h.test")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = ItemSink(str(tmp_path / "out"), rules={"url": F.col("url").startswith("https")}).start(items, str(tmp_path / "cp"), 0.1)
    more.flush()
    again = spark.createDataFrame([("https://h.test/new", "t", "h.test")], schema)
    more(again, 2)
    more.close()
    assert spark.read.json(str(tmp_path / "out" / "items")).count() == 9
    assert more.close()["flushes"] == 2  # closed twice does no harm
