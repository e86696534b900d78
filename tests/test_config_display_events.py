import json

import pytest
from pyspark.sql import functions as F

from siltstream import config
from siltstream.functions import display as D
from siltstream.streaming import events


def test_settings(tmp_path, monkeypatch):
    monkeypatch.delenv("SILTSTREAM_DATA_DIR", raising=False)
    monkeypatch.delenv("SILTSTREAM_MAX_WORKERS", raising=False)
    path = tmp_path / "x" / "config.yaml"
    assert config.load(path) == config.Settings()
    config.Settings(max_retries=7).save(path)
    path.write_text(path.read_text() + "unknown: 1\n")
    assert config.load(path).max_retries == 7
    monkeypatch.setenv("SILTSTREAM_MAX_WORKERS", "2")
    monkeypatch.setenv("SILTSTREAM_DATA_DIR", "~/d")
    got = config.load(path)
    assert got.default_workers == 2 and "~" not in got.data_dir
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert config.config_path() == tmp_path / "siltstream" / "config.yaml"
    s = config.Settings()
    assert s.changed(11, -1, 4) == s and s.changed(10, 0, 5) == config.Settings(default_workers=10, request_delay=0, timeout_seconds=5)


def test_lookups(spark):
    df = spark.createDataFrame([("failed",), ("nothing",), (None,)], "s string")
    assert [r[0] for r in df.select(D.looked_up("s", D.STATUS_ICONS)).collect()] == ["✗", "●", "●"]
    assert [r[0] for r in df.select(D.one_of("s", D.CIRCUITS)).collect()] == ["closed"] * 3
    arrows = spark.createDataFrame([(12.0, 10.0), (8.0, 10.0), (10.5, 10.0)], "a double, b double")
    assert [r[0] for r in arrows.select(D.speed_arrow("a", "b")).collect()] == ["↑", "↓", "→"]


def test_events(spark, tmp_path):
    rows = [{"seq": 1, "kind": "error", "ts": "2025-01-01T00:00:00Z", "payload": json.dumps({"url": "u", "retry_count": 2})}, {"seq": 2, "kind": "error", "ts": "2025-01-01T00:00:01Z", "payload": "broken"}, {"seq": 3, "kind": "alert", "ts": None, "payload": "{}"}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    listener = events.ProgressListener(lambda *x: seen.append(x))
    spark.streams.addListener(listener)
    stream = events.routed(events.read_events(spark, str(tmp_path)), "error", "url string, retry_count int")
    query = stream.writeStream.format("memory").queryName("errors").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.seq, r.url, r.retry_count) for r in spark.table("errors").orderBy("seq").collect()] == [(1, "u", 2), (2, None, None)]
    batch = events.read_events(spark, str(tmp_path), stream=False)
    assert batch.count() == 3 and events.routed(batch, "alert", "level string").count() == 1
    spark.streams.removeListener(listener)
    with pytest.raises(ValueError):
        events.routed(batch, "gossip", "x int")
    assert F is not None
