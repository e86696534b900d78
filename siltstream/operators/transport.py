"""Requests that are tried several times: outcomes, the events they give, and the breaker's state at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions.text import transport_wait
from siltstream.operators.policies import Breaker

# The answers of the transport itself: the circuit is open, and the tries are used up.
OPEN_STATUS, EXHAUSTED_STATUS = 421, 504


def outcomes(attempts: DataFrame, most: int = 3, allowed: Column | None = None) -> DataFrame:
    """(request, status, attempts, waited) of attempts (request, attempt, status), ``attempt`` counted from 1.

    A request ends at its first attempt that is no failure (below 500). An attempt that the breaker does not let
    through ends it with OPEN_STATUS; ``most`` failures end it with EXHAUSTED_STATUS. Attempts beyond the end were
    never made and count for nothing. ``waited`` are the seconds between attempts, without jitter. A null status is a
    failure. All are aggregates, so a host with very many requests is no burden.
    """
    open_ = ~F.coalesce(allowed, F.lit(True)) if allowed is not None else F.lit(False)
    rows = attempts.filter(F.col("attempt").between(1, most)).withColumn("_open", open_)
    ends = F.col("_open") | F.coalesce(F.col("status") < 500, F.lit(False))
    per = rows.groupBy("request").agg(
        F.min(F.when(ends, F.struct("attempt", F.when(F.col("_open"), OPEN_STATUS).otherwise(F.col("status")).alias("status")))).alias("_end"),
        F.max("attempt").alias("_last"),
        F.max_by("status", "attempt").alias("_status"),
    )
    made = F.coalesce(F.col("_end.attempt"), F.col("_last"))
    status = F.coalesce(F.col("_end.status"), F.when(F.col("_last") >= most, EXHAUSTED_STATUS).otherwise(F.col("_status")))
    waited = F.aggregate(F.when(made > 1, F.sequence(F.lit(1).cast("int"), (made - 1).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, k: a + transport_wait(k))
    return per.select("request", status.cast("int").alias("status"), made.cast("int").alias("attempts"), waited.alias("waited"))


def retry_events(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(request, kind, attempt, status, wait): a ``network_retry`` for each failure that is followed by another try."""
    again = F.coalesce(F.col("status") >= 500, F.lit(True)) & (F.col("attempt") < most)
    return attempts.filter(again).select("request", F.lit("network_retry").alias("kind"), "attempt", "status", transport_wait(F.col("attempt")).alias("wait"))


def circuit_events(folded: DataFrame, key: str, at: str) -> DataFrame:
    """(key, kind, at, state): a ``circuit_state`` for each event at which a key's breaker changes its state.

    ``folded`` is what ``fold`` gives. The first event counts if it opens the breaker.
    """
    before = F.coalesce(F.lag("state").over(Window.partitionBy(key).orderBy(at, "failures")), F.lit("closed"))
    changed = folded.withColumn("_before", before).filter(F.col("state") != F.col("_before"))
    return changed.select(key, F.lit("circuit_state").alias("kind"), at, "state")


def breaker_states(folded: DataFrame, asked: DataFrame, policy: Breaker, key: str, at: str) -> DataFrame:
    """(key, asked, state) of the times ``asked`` (key, asked): ``closed``, ``open``, or ``half-open`` after the wait.

    The state is that which the last event not after the time left. Openings and questions meet in one shuffle by key
    and day, and the last event of each earlier day is carried on by day, so a busy key is spread over its days.
    Times are timestamps; keys and times that are null have no state and give ``closed``.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # Only events that a breaker let through change its state; what it rejects leaves the opening's time as it was.
    events = folded.filter(F.col("allowed") & F.col(at).isNotNull()).select(F.col(key).alias("key"), micros(at).alias("at"), (F.col("state") == "open").alias("open"))
    events = events.groupBy("key", "at").agg(F.max("open").alias("open"))
    points = events.withColumn("question", F.lit(False)).unionByName(asked.select(F.col(key).alias("key"), micros("asked").alias("at"), F.lit(None).cast("boolean").alias("open"), F.lit(True).alias("question")))
    points = points.withColumn("day", F.floor(F.col("at") / F.lit(86_400_000_000)))
    days = points.filter(~F.col("question")).groupBy("key", "day").agg(F.max(F.struct("at", "open")).alias("last"))
    carried = days.select("key", "day", F.max("last").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("last"))
    within = Window.partitionBy("key", "day").orderBy("at", "question").rowsBetween(Window.unboundedPreceding, 0)
    seen = points.withColumn("last", F.max(F.when(~F.col("question"), F.struct("at", "open"))).over(within)).filter("question").select("key", "at", "day", "last")
    # Questions before the first event of their day take the end of the last day before with events.
    marks = carried.select("key", "day", "last", F.lit(None).cast("bigint").alias("asked")).unionByName(seen.filter("last IS NULL").select("key", "day", F.lit(None).cast("struct<at:bigint,open:boolean>").alias("last"), F.col("at").alias("asked")))
    by_day = Window.partitionBy("key").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    early = marks.withColumn("last", F.max(F.when(F.col("asked").isNull(), F.col("last"))).over(by_day)).filter("asked IS NOT NULL").select("key", F.col("asked").alias("at"), "last")
    found = seen.filter("last IS NOT NULL").select("key", "at", "last").unionByName(early)
    state = F.when(~F.coalesce(F.col("last.open"), F.lit(False)), "closed").when(F.col("at") < F.col("last.at") + policy.timeout, "open").otherwise("half-open")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias("asked"), state.alias("state"))
