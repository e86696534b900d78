"""The store of addresses and their states as set-based merges over DataFrames.

Spark enforces no key, so every merge keeps one row an address itself. Windows are avoided where an aggregate
does: the last change of an address is ``max_by``, which combines before the shuffle, so a hot address is no burden.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions.urls import admissible, netloc

# The states of an address, and how long a stored error may be.
STATUSES = ("pending", "discovered", "in_progress", "completed", "failed", "skipped_robots")
LONGEST_ERROR = 500


def latest(rows: DataFrame, key: str, order: Column, columns: list[str] | None = None) -> DataFrame:
    """One row a key: the one with the greatest ``order``. Ties are broken by all other columns, so the result is one."""
    rest = [c for c in (columns or rows.columns) if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = rows.groupBy(key).agg(F.max_by(row, F.struct(order.alias("_order"), *[F.col(f"`{c}`") for c in rest])).alias("_row"))
    return best.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def insert_ignore(store: DataFrame, new: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(store, refused): the store with the new addresses it lacks, and the rows whose address it cannot take.

    A stored row is never touched; of several new rows of an address the one with the least ``order`` counts.
    """
    good, refused = new.filter(admissible("url")), new.filter(~admissible("url"))
    rest = [c for c in new.columns if c != "url"]
    row = F.struct(*[F.col(c) for c in rest])
    first = good.groupBy("url").agg(F.min_by(row, F.struct(order.alias("_order"), *[F.col(c) for c in rest])).alias("_row"))
    first = first.select("url", *[F.col(f"_row.{c}").alias(c) for c in rest])
    fresh = first.join(store.select("url").distinct(), "url", "left_anti")
    return store.unionByName(fresh, allowMissingColumns=True), refused


def merge_status(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after ``changes`` (url, status, error, at, seq): the last change of an address wins.

    A change without an error clears the stored one; errors are cut to their longest length; addresses that the
    store does not know are ignored.
    """
    last = latest(changes, "url", F.col("seq"), ["status", "error", "at"]).select("url", F.struct("status", "error", "at").alias("_new"))
    joined = store.join(last, "url", "left")
    changed = F.col("_new").isNotNull()
    return joined.select(
        "url",
        F.when(changed, F.col("_new.status")).otherwise(F.col("status")).alias("status"),
        "type", "retries",
        F.when(changed, F.left("_new.error", F.lit(LONGEST_ERROR))).otherwise(F.col("last_error")).alias("last_error"),
        F.when(changed, F.col("_new.at")).otherwise(F.col("last_try")).alias("last_try"),
        "discovered_at",
    )


def add_retries(store: DataFrame, failures: DataFrame) -> DataFrame:
    """The store with one retry more for every row of ``failures`` (url); unknown addresses are ignored."""
    counts = failures.groupBy("url").agg(F.count("*").alias("_more"))
    joined = store.join(counts, "url", "left")
    return joined.withColumn("retries", (F.coalesce("retries", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("int")).drop("_more")


def pending(store: DataFrame, kind: str, most_retries: int = 3) -> DataFrame:
    """The addresses of a kind to fetch: pending, or failed with tries left."""
    tries = F.coalesce("retries", F.lit(0)) < most_retries
    return store.filter((F.col("type") == kind) & ((F.col("status") == "pending") | ((F.col("status") == "failed") & tries)))


def page(store: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the store in order of the address, so pages neither overlap nor leave gaps.

    Repeated rows of an address follow each other in order of their other columns.
    """
    rest = [c for c in store.columns if c != "url"]
    return store.orderBy("url", *rest).offset(offset).limit(limit)


def cancelled(store: DataFrame) -> DataFrame:
    """The store after its workers were stopped: what was in progress is pending again."""
    return store.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def next_tries(failures: DataFrame, most_retries: int = 3) -> DataFrame:
    """``failures`` (with retries, last_try) with ``attempt``, ``again`` and, where again, the time ``next_try``."""
    attempt = F.coalesce("retries", F.lit(0)) + 1
    again = attempt < most_retries
    wait = F.make_dt_interval(secs=F.pow(F.lit(2.0), attempt).cast("decimal(18,6)"))
    return failures.withColumns({"attempt": attempt, "again": again, "next_try": F.when(again, F.col("last_try") + wait)})


def reset_domain(store: DataFrame, domain: str) -> DataFrame:
    """The store without the addresses of one site; rows without an address stay. ``of_domain`` tells what goes."""
    return store.filter(F.coalesce(netloc("url") != domain, F.lit(True)))


def of_domain(store: DataFrame, domain: str) -> DataFrame:
    """The rows that ``reset_domain`` drops, to be counted or kept."""
    return store.filter(netloc("url") == domain)


class MissionLock:
    """One mission a site: a file that only one process can create."""

    def __init__(self, folder: str, domain: str) -> None:
        self.path = Path(folder) / f"{domain.replace('/', '_')}.lock"

    def acquire(self) -> bool:
        try:
            with open(self.path, "x") as lock:
                lock.write(str(os.getpid()))
            return True
        except OSError:
            return False

    def release(self) -> bool:
        try:
            if self.path.read_text() != str(os.getpid()):
                return False
            self.path.unlink()
            return True
        except OSError:
            return False
