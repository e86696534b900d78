"""Sequential policies over events, for keys of any size.

A circuit breaker or a throttle is a fold: what an event does depends on all before it. One key may hold a third of
all events, so no task gets a key as a whole. The events are range-partitioned by key and time and cut into blocks of
bounded size. A block is summed up as a function from the state before it to the state after it; the functions of a
key's blocks, few and small, are applied one after the other; then every block is replayed from the state it starts
in. Keys that lie within one task and one block, which are most, are folded at once. Batch and streaming share the
step functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.session import materialize

#: Events of a block: what one task holds at a time.
BLOCK = 100_000
#: No time: nothing is blocked, nothing was kept.
NEVER = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Breaker:
    """Opens for ``timeout`` microseconds at ``threshold`` failures without a success between.

    State: (failures, blocked until). An event while blocked is rejected and changes nothing. The first event after
    the time starts afresh. A success closes; an event whose outcome is unknown (null) is let through and changes
    nothing else.
    """

    threshold: int = 5
    timeout: int = 300_000_000

    start = (0, NEVER)
    outputs = (("allowed", pa.bool_()), ("state", pa.string()), ("failures", pa.int32()))

    def step(self, state: tuple[int, int], at: int, ok: bool | None) -> tuple[tuple[int, int], tuple]:
        failures, until = state
        if until != NEVER:
            if at < until:
                return state, (False, "open", failures)
            failures, until = 0, NEVER
        if ok is None:
            return (failures, until), (True, "closed", failures)
        if ok:
            return self.start, (True, "closed", 0)
        failures += 1
        if failures >= self.threshold:
            until = at + self.timeout
        return (failures, until), (True, "closed" if until == NEVER else "open", failures)

    def summary(self, at: np.ndarray, ok: list[bool | None]) -> dict:
        n, threshold = len(at), self.threshold
        failed = np.array([x is False for x in ok])
        fails = np.flatnonzero(failed)
        before = np.r_[0, np.cumsum(failed)]  # failures before each event
        succeeded = np.flatnonzero([x is True for x in ok])
        following = np.r_[succeeded, n][np.searchsorted(succeeded, np.arange(n + 1))]  # the next success from each event
        reopened = np.searchsorted(at, at[fails] + self.timeout)  # the first event that a block begun at a failure lets through
        fresh: list[tuple[int, int]] = [self.start] * (n + 1)

        def after(i: int, failures: int) -> tuple[int, int]:
            """The state after the block if ``failures`` are counted before event ``i`` and nothing is blocked."""
            at_limit = before[i] + threshold - failures - 1
            if at_limit < len(fails) and fails[at_limit] < following[i]:
                k = reopened[at_limit]
                return fresh[k] if k < n else (threshold, int(at[fails[at_limit]]) + self.timeout)
            if following[i] < n:
                return fresh[following[i] + 1]
            return failures + len(fails) - int(before[i]), NEVER

        for i in range(n - 1, -1, -1):
            fresh[i] = after(i, 0)
        return {"closed": [after(0, f) for f in range(threshold)], **_changes(at, fresh, self.timeout)}

    def apply(self, state: tuple[int, int], summary: dict) -> tuple[int, int]:
        failures, until = state
        if until == NEVER:
            return tuple(summary["closed"][failures])
        return _at_time(until, summary, state)


@dataclass(frozen=True)
class Throttle:
    """Keeps an event only if ``interval`` microseconds have passed since the last one kept."""

    interval: int = 100_000

    start = (NEVER,)
    outputs = (("kept", pa.bool_()),)

    def step(self, state: tuple[int], at: int, ok: bool | None = None) -> tuple[tuple[int], tuple]:
        if state[0] != NEVER and at - state[0] < self.interval:
            return state, (False,)
        return (at,), (True,)

    def summary(self, at: np.ndarray, ok: list[bool | None]) -> dict:
        n = len(at)
        following = np.searchsorted(at, at + self.interval)
        last: list[tuple[int]] = [self.start] * (n + 1)
        for i in range(n - 1, -1, -1):
            last[i] = last[following[i]] if following[i] < n else (int(at[i]),)
        return {"closed": [last[0]], **_changes(at, last, self.interval)}

    def apply(self, state: tuple[int], summary: dict) -> tuple[int]:
        if state[0] == NEVER:
            return tuple(summary["closed"][0])
        return _at_time(state[0] + self.interval, summary, state)


def _changes(at: np.ndarray, states: list[tuple], reach: int) -> dict:
    """Where the state after the block changes with the event it is entered at, as far as a wait of ``reach`` can go."""
    places = [i for i in range(1, len(at)) if states[i] != states[i - 1] and at[i - 1] <= at[0] + reach]
    return {"times": [int(at[i - 1]) for i in places], "states": [states[0], *(states[i] for i in places)], "last": int(at[-1])}


def _at_time(due: int, summary: dict, state: tuple) -> tuple:
    """The state after a block that is waited out until ``due``."""
    if due > summary["last"]:
        return state
    return tuple(summary["states"][int(np.searchsorted(np.array(summary["times"], dtype=np.int64), due))])


def fold(events: DataFrame, policy: Breaker | Throttle, key: str, at: str, ok: str | None = None, ties: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``events`` with the policy's outputs: for each key in order of time, then of ``ties``.

    Events without a time take no part: their outputs are null. Null keys are one key. Rows that agree in key, time
    and all ties are interchangeable. An empty table gives an empty result.
    """
    ties = tuple(c for c in ties if c not in (key, at))
    columns = [c for c in events.columns if not c.startswith("_fold_")]
    order = [F.col(key), F.col("_fold_at"), *[F.col(c) for c in ties], *([F.col(ok)] if ok and ok not in ties else [])]
    events = events.select(*columns)
    timed = events.filter(F.col(at).isNotNull()).withColumn("_fold_at", F.unix_micros(F.col(at).cast("timestamp")))
    timed = timed.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = {pa.bool_(): "boolean", pa.string(): "string", pa.int32(): "int"}
    extra = {"_fold_block": F.lit(None).cast("string"), "_fold_sum": F.lit(None).cast("string")} | {n: F.lit(None).cast(kinds[t]) for n, t in policy.outputs}
    cut_schema = timed.withColumns(extra).schema
    key_at, time_at, ok_at = columns.index(key), len(columns), columns.index(ok) if ok else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one key each. A key that lies in this task as a whole and in one block is folded at once."""
        import json

        from pyspark import TaskContext

        number, held, size, held_key, opened = 0, [], 0, None, True

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            outcome = rows.column(ok_at).to_pylist() if ok_at is not None else [None] * size
            n, held, size = size, [], 0
            if whole:
                results = fold_in_memory(policy, list(zip(rows.column(time_at).to_pylist(), outcome)))
                names, sums = [None] * n, [None] * n
            else:
                told = json.dumps(policy.summary(rows.column(time_at).to_numpy(), outcome))
                names, sums = [f"{TaskContext.get().partitionId():08d}-{number:08d}"] * n, [told] + [None] * (n - 1)
                number, results = number + 1, [(None,) * len(policy.outputs)] * n
            rows = rows.append_column("_fold_block", pa.array(names, pa.string())).append_column("_fold_sum", pa.array(sums, pa.string()))
            for k, (name, kind) in enumerate(policy.outputs):
                rows = rows.append_column(name, pa.array([r[k] for r in results], kind))
            yield from rows.to_batches(max_chunksize=10_000)

        # The first and the last key of a task may go on in the tasks beside it.
        for batch in batches:
            keys = batch.column(key_at).to_pylist()
            start = 0
            while start < batch.num_rows:
                if held and keys[start] != held_key:
                    yield from flush(not opened)
                    opened = False
                elif held and size >= block:
                    yield from flush(False)
                    opened = True  # what follows of this key is not its beginning
                held_key, end = keys[start], start
                while end < batch.num_rows and keys[end] == held_key and size + end - start < block:
                    end += 1
                held.append(batch.slice(start, end - start))
                size, start = size + end - start, end
        if held:
            yield from flush(False)

    folded = materialize(timed.mapInArrow(cut, cut_schema), "blocks")
    whole = folded.filter("_fold_block IS NULL").drop("_fold_at", "_fold_block", "_fold_sum")
    blocks = folded.filter("_fold_block IS NOT NULL").drop(*[n for n, _ in policy.outputs])
    told = blocks.filter("_fold_sum IS NOT NULL").select(F.col(key).alias("key"), "_fold_block", "_fold_sum")

    def chain(rows: pa.Table) -> pa.Table:
        import json

        rows = rows.sort_by("_fold_block")
        state, states = policy.start, []
        for summary in rows.column("_fold_sum").to_pylist():
            states.append(json.dumps(state))
            state = policy.apply(state, json.loads(summary))
        return pa.table({"_fold_block": rows.column("_fold_block"), "_fold_state": pa.array(states, pa.string())})

    states = told.groupBy("key").applyInArrow(chain, "_fold_block string, _fold_state string")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), *(f"{n} {kinds[t]}" for n, t in policy.outputs)])
    plain_order = ["_fold_at", *ties, *([ok] if ok and ok not in ties else [])]

    def replay(rows: pa.Table, entry: pa.Table) -> pa.Table:
        import json

        # Spark puts nulls first when it sorts; so must the replay.
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[(c, "ascending") for c in plain_order], null_placement="at_start"))
        state = tuple(json.loads(entry.column("_fold_state")[0].as_py()))
        outcome = rows.column(ok).to_pylist() if ok else [None] * len(rows)
        results = []
        for moment, x in zip(rows.column("_fold_at").to_pylist(), outcome):
            state, result = policy.step(state, moment, x)
            results.append(result)
        out = rows.select(columns)
        for k, (name, kind) in enumerate(policy.outputs):
            out = out.append_column(name, pa.array([r[k] for r in results], kind))
        return out

    done = blocks.drop("_fold_sum").groupBy("_fold_block").cogroup(states.groupBy("_fold_block")).applyInArrow(replay, schema)
    untimed = events.filter(F.col(at).isNull())
    for name, kind in policy.outputs:
        untimed = untimed.withColumn(name, F.lit(None).cast(kinds[kind]))
    return whole.unionByName(done).unionByName(untimed)


def fold_in_memory(policy: Breaker | Throttle, events: list[tuple[int, bool | None]]) -> list[tuple]:
    """The policy's outputs for events in order: the plain loop that everything else must equal."""
    state, out = policy.start, []
    for at, ok in events:
        state, result = policy.step(state, at, ok)
        out.append(result)
    return out
