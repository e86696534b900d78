import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.operators.policies import NEVER, Breaker, Throttle, fold, fold_in_memory

SCHEMA = "k string, at timestamp, ok boolean, extra string"


def events(spark, rows):
    df = spark.createDataFrame([(k, t, ok, "x") for k, t, ok in rows], "k string, us bigint, ok boolean, extra string")
    return df.select("k", F.timestamp_micros("us").alias("at"), "ok", "extra")


def test_breaker_by_hand():
    out = fold_in_memory(Breaker(2, 10), [(0, False), (1, False), (5, True), (11, False), (12, False), (30, True), (31, None)])
    assert [o[0] for o in out] == [True, True, False, True, True, True, True]
    assert [o[1] for o in out] == ["closed", "open", "open", "closed", "open", "closed", "closed"]
    assert fold_in_memory(Breaker(2, 10), [(0, False), (1, True), (2, False)])[2][1] == "closed"


def test_throttle_by_hand():
    assert [o[0] for o in fold_in_memory(Throttle(100), [(0, None), (50, None), (99, None), (100, None), (199, None), (200, None)])] == [True, False, False, True, False, True]


@pytest.mark.parametrize("seed", range(60))
def test_blocks_compose(seed):
    rng = random.Random(seed)
    policy = Breaker(rng.choice([1, 2, 3, 5]), rng.choice([3, 10, 50])) if seed % 3 else Throttle(rng.choice([3, 10]))
    n = rng.randint(1, 80)
    times = sorted(rng.randint(0, 150) for _ in range(n))
    rows = [(t, rng.choice([True, False, False, False, None])) for t in times]
    cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(6))})
    state, got = policy.start, []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part, inner = rows[a:b], state
        for event in part:
            inner, result = policy.step(inner, *event)
            got.append(result)
        state = policy.apply(state, policy.summary(np.array([t for t, _ in part]), [o for _, o in part]))
        assert state[-1] == inner[-1] and (state[0] == inner[0] or state[-1] != NEVER)
    assert got == fold_in_memory(policy, rows)


def test_distributed_fold_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(0, 5_000), rng.choice([True, False, False, False, None])) for _ in range(3_000)]
    policy = Breaker(3, 200)
    out = fold(events(spark, rows), policy, "k", "at", "ok", block=40).select("k", F.unix_micros("at").alias("us"), "ok", "allowed", "state", "failures", "extra").collect()
    want = []
    for key in {k for k, _, _ in rows}:
        mine = sorted(((t, ok) for k, t, ok in rows if k == key), key=lambda r: (r[0], r[1] is not None, bool(r[1])))
        want += [(key, *e, *r) for e, r in zip(mine, fold_in_memory(policy, mine))]
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in out), key=order) == sorted(want, key=order)


def test_fold_edges(spark):
    df = events(spark, [("a", 1, False), (None, 2, None), ("a", 1, False)]).unionByName(events(spark, [("a", 5, True)]).withColumn("at", F.lit(None).cast("timestamp")))
    out = fold(df, Breaker(1, 10), "k", "at", "ok").collect()
    assert len(out) == 4 and sum(r.allowed is None for r in out) == 1
    assert fold(df.limit(0), Breaker(), "k", "at", "ok").count() == 0
    assert set(fold(df, Throttle(), "k", "at").columns) == {"k", "at", "ok", "extra", "kept"}
