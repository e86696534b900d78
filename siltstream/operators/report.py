"""Mission reports: histograms, top errors, counters, rates and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions.text import ratio_percent, shortened


def status_histogram(store: DataFrame) -> DataFrame:
    return store.groupBy("status").agg(F.count("*").alias("count"))


def status_totals(store: DataFrame) -> DataFrame:
    """The histogram and its grand total, whose status is ``TOTAL``; null states are ``(none)``."""
    rolled = store.rollup("status").agg(F.count("*").alias("count"), F.grouping("status").alias("total"))
    return rolled.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.coalesce("status", F.lit("(none)"))).alias("status"), "count")


def stats_map(store: DataFrame) -> DataFrame:
    """One row: how many addresses are in each state, and of each kind."""
    states = ("pending", "completed", "failed", "skipped_robots")
    return store.agg(
        *[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s) for s in states],
        F.count_if(F.coalesce(F.col("type") == "webpage", F.lit(False))).alias("total_webpages"),
        F.count_if(F.coalesce(F.col("type") == "asset", F.lit(False))).alias("total_assets"),
        F.count("*").alias("total"),
    )


def top_errors(store: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent errors of failed addresses; grouped as stored, so no error and the word are two groups."""
    counts = store.filter("status = 'failed'").groupBy("last_error").agg(F.count("*").alias("count"))
    shown = F.coalesce("last_error", F.lit("Unknown"))
    return counts.select(shown.alias("error"), "count", F.col("last_error").isNull().alias("missing")).orderBy(F.desc("count"), "error", "missing").limit(n)


def errors_by_type(errors: DataFrame, kind: str, message: str, at: str, retries: str, seq: str) -> DataFrame:
    """(type, count, first_message, first_at, retries, first_seq) of each kind of error."""
    return errors.groupBy(F.col(kind).alias("type")).agg(
        F.count("*").alias("count"),
        F.min_by(message, seq).alias("first_message"),
        F.min_by(at, seq).alias("first_at"),
        F.sum(F.coalesce(F.col(retries), F.lit(0))).alias("retries"),
        F.min(seq).alias("first_seq"),
    )


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition; a null condition is not met."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def progress(rows: DataFrame, done: Column) -> DataFrame:
    """One row: done, total and percent, 0 of nothing."""
    counted = rows.agg(F.count_if(F.coalesce(done, F.lit(False))).alias("completed"), F.count("*").alias("total"))
    return counted.withColumn("percent", ratio_percent("completed", "total"))


def last_n(rows: DataFrame, n: int, seq: str) -> DataFrame:
    """The last rows by ``seq``, newest first: a top-k, not a window over everything."""
    return rows.orderBy(F.desc(seq)).limit(n)


def first_of_each(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), seq).alias("_row"))
    return first.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def speed_series(events: DataFrame, ts: str, window: str = "1 second", *keys: str) -> DataFrame:
    """(keys..., at, n): events in each tumbling window that has any."""
    grouped = events.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("at"), "n")


def rolling(series: DataFrame, keys: list[str], value: str = "n", at: str = "at", size: int = 60) -> DataFrame:
    """The series with mean and maximum of the last ``size`` samples.

    A series is already one row a window, so its length is bounded by time, not by the number of events.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-(size - 1), 0)
    return series.withColumns({"mean": F.avg(value).over(w), "most": F.max(value).over(w)})


def trend(series: DataFrame, keys: list[str], value: str = "n", at: str = "at", recent: int = 10, margin: float = 0.1) -> DataFrame:
    """The series with ``trend``: the mean of the last samples against those before, ``up``, ``down`` or ``flat``.

    With fewer than twice ``recent`` samples the older ones are the first half; with fewer than two all is flat.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    n = F.row_number().over(order)
    new = F.avg(value).over(order.rowsBetween(-(recent - 1), 0))
    before = F.avg(value).over(order.rowsBetween(-(2 * recent - 1), -recent))
    # Short series: the mean of the first half, from running sums kept as an array of at most 2 * recent values.
    head = F.collect_list(F.col(value).cast("double")).over(order.rowsBetween(-(2 * recent - 1), 0))
    half = F.floor(F.size("_head") / 2).cast("int")
    first = F.aggregate(F.slice("_head", F.lit(1), half), F.lit(0.0), lambda a, x: a + x) / half
    rows = series.withColumns({"_n": n, "_new": new, "_before": before, "_head": head})
    older = F.when(F.col("_n") >= 2 * recent, F.col("_before")).when(F.col("_n") >= 2, first)
    mark = F.when(F.col("_new") > (1 + margin) * older, "up").when(F.col("_new") < (1 - margin) * older, "down").otherwise("flat")
    return rows.withColumn("trend", mark).drop("_n", "_new", "_before", "_head")


def sparkline(series: DataFrame, keys: list[str], value: str = "n", at: str = "at", size: int = 60) -> DataFrame:
    """(keys..., levels, line): the last samples as levels 0 to 8 of their maximum, and drawn."""
    glyphs = F.array(*[F.lit(g) for g in " ▁▂▃▄▅▆▇█"])
    ranked = series.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).filter(F.col("_back") <= size)
    kept = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col(value).cast("double").alias("v")))).alias("_s"), F.max(F.col(value).cast("double")).alias("_m"))
    level = F.transform("_s", lambda s: F.when(F.col("_m") > 0, F.floor(F.least(s["v"] / F.col("_m"), F.lit(1.0)) * 8)).otherwise(0).cast("int"))
    kept = kept.withColumn("levels", level)
    return kept.select(*keys, F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"), F.array_join(F.transform("levels", lambda x: F.element_at(glyphs, x + 1)), "").alias("line"))


def latency_stats(samples: DataFrame, value: str, threshold: float) -> DataFrame:
    """One row: maximum, mean and number of samples above a threshold."""
    v = F.col(value)
    return samples.filter(v > threshold).agg(F.max(v).alias("most"), F.avg(v).alias("mean"), F.count("*").alias("count"))


def running_total(batches: DataFrame, size: str, order: str, part: Column | None = None) -> DataFrame:
    """Items written so far after each batch, by two levels of prefix sums.

    ``part`` cuts the batches into parts whose order is that of the batches (by default the day of a time, or its
    thousands of a number); sums run within parts, and one task sees a row a part. Ties in ``order`` add together.
    """
    kind = batches.schema[order].dataType.simpleString()
    if part is None:
        part = F.to_date(F.col(order)) if kind.startswith(("date", "timestamp")) else F.floor(F.col(order).cast("double") / 1000)
    rows = batches.withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum(size).alias("_size"))
    before = sums.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.coalesce("_size", F.lit(0))).alias("_before"))
    own = F.sum(size).over(Window.partitionBy("_part").orderBy(order))
    joined = rows.withColumn("_own", own).join(before.withColumnRenamed("_part", "_of"), F.col("_part").eqNullSafe(F.col("_of")))
    return joined.withColumn("total", F.coalesce("_before", F.lit(0)) + F.col("_own")).drop("_part", "_of", "_own", "_before")


def mission_report(store: DataFrame, n: int = 5, longest: int = 80) -> DataFrame:
    """The report of a mission as one table (section, name, value): states, their total, and the top errors.

    Sections are ``status``, ``total`` and ``error``; errors are cut as they are shown.
    """
    totals = status_totals(store).select(F.when(F.col("status") == "TOTAL", "total").otherwise("status").alias("section"), F.col("status").alias("name"), F.col("count").alias("value"))
    errors = top_errors(store, n).select(F.lit("error").alias("section"), shortened("error", longest).alias("name"), F.col("count").alias("value"))
    return totals.unionAll(errors)
