"""The engine's events as one table: all kinds are kept, and each view filters its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# The kinds of event, and those that are thinned before they are shown.
KINDS = ("progress", "speed", "activity", "network_retry", "circuit_state", "data_saved", "error", "system_status", "state_change", "alert", "command")
THINNED = ("progress", "activity")
SCHEMA = "seq bigint, kind string, ts timestamp, payload string"


def read_events(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Events of JSON files in a folder; the payload of each kind is JSON of its own."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMA).json(folder)


def routed(events: DataFrame, kind: str, schema: str) -> DataFrame:
    """One kind's events with their payload as columns; payloads that do not parse give nulls."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return events.filter(F.col("kind") == kind).select("seq", "ts", F.from_json("payload", schema).alias("p")).select("seq", "ts", "p.*")


class ProgressListener(StreamingQueryListener):
    """Tells a callback what each micro-batch took: the twin of callbacks on flush."""

    def __init__(self, told: Callable[[str, int, float], None]) -> None:
        self.told = told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told(p.name or str(p.id), p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
