"""Policies and deduplication on Structured Streaming, with the step functions of the batch operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstream.operators.policies import Breaker, Throttle
from siltstream.operators.state import latest, merge_status
from siltstream.session import read_text, write_text


def fold_stream(events: DataFrame, policy: Breaker | Throttle, key: str, at: str, ok: str | None = None, idle: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, at, ok, outputs...) of a stream of events, each key's state kept from batch to batch.

    Within a batch a key's events are taken in order of time; what comes in a later batch is taken later. Keys
    without a time are dropped. With ``idle`` the state of a key goes when the watermark, ``late`` behind the latest
    event, has passed its last event by that many seconds; a key that comes back starts afresh. For a breaker, a time
    beyond its wait changes at most the count of failures that such a key starts from.
    """
    spark_kinds = {"bool": "boolean", "string": "string", "int32": "int"}
    if idle is not None:
        events = events.withColumn("_time", F.col(at).cast("timestamp")).withWatermark("_time", late)
    rows = events.filter(F.col(at).isNotNull()).select(*(["_time"] if idle is not None else []), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), (F.col(ok) if ok else F.lit(None).cast("boolean")).alias("ok"))
    schema = "key string, at bigint, ok boolean, " + ", ".join(f"{n} {spark_kinds[str(t)]}" for n, t in policy.outputs)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, last = json.loads(state.get[0]) if state.exists else (policy.start, None)
        if idle is not None and last is not None and last + 1_000 * idle < state.getCurrentWatermarkMs():
            now = policy.start  # it was due to go when these events came
        now = tuple(now)
        rows = pd.concat(list(batches)).sort_values(["at", "ok"], na_position="first", kind="stable")
        results = []
        for moment, outcome in zip(rows["at"], rows["ok"]):
            now, result = policy.step(now, int(moment), None if pd.isna(outcome) else bool(outcome))
            results.append(result)
        last = max(last or 0, int(rows["at"].max()) // 1_000)
        state.update((json.dumps([[int(x) for x in now], last]),))
        if idle is not None:
            state.setTimeoutTimestamp(max(last + 1_000 * idle, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame({"key": [group[0]] * len(rows), "at": rows["at"].to_numpy(), "ok": rows["ok"].to_numpy()})
        for k, (name, _) in enumerate(policy.outputs):
            out[name] = [r[k] for r in results]
        yield out

    return rows.groupBy("key").applyInPandasWithState(run, schema, "state string", "append", timeout)


def first_seen(events: DataFrame, key: str, at: str, ttl: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark: the state of a key goes when it has passed."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", ttl).dropDuplicatesWithinWatermark([key]).drop("_at")


def speed_stream(events: DataFrame, at: str, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(at, n): events in each tumbling window, once it is closed by the watermark."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("at"), "n")


class StoreSink:
    """Applies micro-batches of status changes to a store kept in a folder: a base and the changes since.

    A batch writes its changes alone; every COMPACT batches they are merged into a new base. A pointer file then names
    what makes up the store, so a reader sees whole batches; after a restart the sink goes on from there, and a batch
    that is delivered again is recognised by its number.
    """

    COMPACT = 20

    def __init__(self, store: DataFrame, folder: str) -> None:
        self.spark, self.folder = store.sparkSession, folder.rstrip("/")
        known = read_text(self.spark, f"{self.folder}/CURRENT")
        if known:
            self.state = json.loads(known)
        else:
            self.state = {"base": f"{self.folder}/base-0", "changes": [], "batch": -1}
            store.write.mode("overwrite").parquet(self.state["base"])
            self._point()

    def _point(self) -> None:
        write_text(self.spark, f"{self.folder}/CURRENT", json.dumps(self.state))

    @property
    def store(self) -> DataFrame:
        """The store after all batches so far."""
        base, changes = self.spark.read.parquet(self.state["base"]), self.state["changes"]
        return merge_status(base, self.spark.read.parquet(*changes)) if changes else base

    def __call__(self, changes: DataFrame, batch: int) -> None:
        if batch <= self.state["batch"]:
            return
        path = f"{self.folder}/changes-{batch:08d}"
        order = F.struct(F.lit(batch).cast("bigint").alias("batch"), F.col("seq").cast("bigint").alias("seq"))
        latest(changes.select("url", "status", "error", "at", order.alias("seq")), "url", F.col("seq")).write.mode("overwrite").parquet(path)
        self.state = {**self.state, "changes": [*self.state["changes"], path], "batch": batch}
        if len(self.state["changes"]) >= self.COMPACT:
            base = f"{self.folder}/base-{batch + 1}"
            self.store.write.mode("overwrite").parquet(base)
            self.state = {"base": base, "changes": [], "batch": batch}
        self._point()
