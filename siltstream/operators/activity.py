"""Views of the activity log (seq, at, url, title, status, error, engine, elapsed_ms): errors, log lines, searches.

The last rows are a top-k by ``seq``, which Spark takes without a full sort; filters of a view come after it, so a view
shows what is left of the last rows, as a screen does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.operators.report import last_n

# The levels of log lines, by status; what an error's kind and missing message are called.
LEVELS = {"error": "ERROR", "warning": "WARNING"}
OTHER_LEVEL, ALL_LEVELS = "INFO", "ALL"
ERROR_TYPE, NO_MESSAGE, SOURCE = "ProcessingError", "Unknown error", "engine"


def level(status: str | Column) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    found = F.lit(OTHER_LEVEL)
    for value, name in LEVELS.items():
        found = F.when(s == value, name).otherwise(found)
    return found


def message() -> Column:
    """The first of title, error and status that says something, and the address behind it."""
    said = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("title", "error", "status")], F.lit(""))
    return F.when(F.coalesce("url", F.lit("")) != "", F.concat(said, F.lit(": "), F.col("url"))).otherwise(said)


def log_lines(activity: DataFrame, limit: int = 100, only: str = ALL_LEVELS) -> DataFrame:
    """(seq, at, level, message, source) of the last ``limit`` entries, of which those of level ``only`` are kept."""
    lines = last_n(activity, limit, "seq").select("seq", "at", level("status").alias("level"), message().alias("message"), F.coalesce("engine", F.lit(SOURCE)).alias("source"))
    return lines if only.upper() == ALL_LEVELS else lines.filter(F.col("level") == only.upper())


def search(lines: DataFrame, text: str) -> DataFrame:
    """The log lines whose message or source contains ``text``, in whatever case; '' keeps all."""
    low = text.lower()
    return lines.filter(F.lower("message").contains(low) | F.lower("source").contains(low)) if text else lines


def error_list(activity: DataFrame, limit: int = 50) -> DataFrame:
    """(seq, at, url, error_type, error_message, retry_count) of the errors among the last ``limit`` entries."""
    failed = last_n(activity, limit, "seq").filter("status = 'error'")
    return failed.select(
        "seq", "at", F.coalesce("url", F.lit("")).alias("url"), F.lit(ERROR_TYPE).alias("error_type"),
        F.coalesce("error", F.lit(NO_MESSAGE)).alias("error_message"), F.lit(0).alias("retry_count"),
    )


def mission_counters(activity: DataFrame, kind: str = "kind") -> DataFrame:
    """One row: successes and failures of pages and assets, and the sum of the failures."""
    page, asset, bad = F.col(kind) == "webpage", F.col(kind) == "asset", F.col("status") == "error"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counted = activity.agg(
        count(page & ~bad).alias("pages_completed"), count(page & bad).alias("pages_failed"),
        count(asset & ~bad).alias("assets_completed"), count(asset & bad).alias("assets_failed"),
    )
    return counted.withColumn("error_count", F.col("pages_failed") + F.col("assets_failed"))


def export_logs(lines: DataFrame, folder: str) -> None:
    """The log lines as JSON, appended in one commit; the file system's own rules say how long they are kept."""
    lines.write.mode("append").json(folder)
