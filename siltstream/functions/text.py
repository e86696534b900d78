"""Text, number and time expressions, all in the JVM but for the repair of mis-decoded text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stripped(text: str | Column) -> Column:
    """Without blanks at either end, no-break and other Unicode blanks included."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+\z", "")


def present(text: str | Column, default: str) -> Column:
    """The text, or ``default`` for null and empty ones."""
    return F.coalesce(F.nullif(_c(text), F.lit("")), F.lit(default))


def clean_text(text: str | Column) -> Column:
    """At most one blank line in a row, and no blanks at the ends. Null stays null."""
    return stripped(F.regexp_replace(_c(text), "\n{3,}", "\n\n"))


# The first byte of a UTF-8 sequence followed by a further one, both read as Latin-1 or Windows-1252.
_MOJIBAKE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]")


def repaired(text: str | None) -> str | None:
    """UTF-8 that was read as Windows-1252 and stored again, put right; any other text as it is."""
    if not text or not _MOJIBAKE.search(text):
        return text
    for encoding in ("cp1252", "latin-1"):
        try:
            return text.encode(encoding).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    # Mixed texts are repaired a line at a time.
    if "\n" in text:
        return "\n".join(repaired(line) for line in text.split("\n"))
    return text


@F.pandas_udf(StringType())
def repair_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([repaired(t) for t in batch], dtype=object)


def anchor_slug(text: str | Column) -> Column:
    """A heading's anchor: lower case, hyphens for blanks, ASCII letters and digits; ``section`` if nothing is left."""
    t = F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\-]", ""), "-+", "-")
    return present(F.regexp_replace(t, r"^-+|-+\z", ""), "section")


def title_clean(og_title: str | Column, title: str | Column, default: str = "Documento") -> Column:
    """The first title that is there, before its first bar and then its first dash between blanks."""
    first = F.coalesce(F.nullif(_c(og_title), F.lit("")), F.nullif(_c(title), F.lit("")), F.lit(default))
    return stripped(F.substring_index(F.substring_index(first, "|", 1), " - ", 1))


def keywords(text: str | Column) -> Column:
    """The parts between commas, without outer blanks and empty ones."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda k: stripped(k)), lambda k: k != "")


def content_key(text: str | Column, first: int = 10_000) -> Column:
    """A digest of the first characters: the key under which repeated extraction is recognised."""
    return F.md5(F.substring(_c(text), 1, first))


def shortened(text: str | Column, longest: int, mark: str = "...") -> Column:
    t = _c(text)
    return F.when(F.char_length(t) > longest, F.concat(F.left(t, F.lit(longest)), F.lit(mark))).otherwise(t)


def human_size(size: str | Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves at least 1, with two decimals."""
    n = _c(size).cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.when(n == 0, "0 B")
    for k, unit in enumerate(units):
        shown = F.concat(F.format_string("%.2f", F.bround(n / F.lit(float(1024**k)), 2)), F.lit(f" {unit}"))
        out = out.when(n < 1024.0 ** (k + 1), shown) if k < len(units) - 1 else out.otherwise(shown)
    return F.when(n.isNotNull(), out)


def elapsed(seconds: str | Column) -> Column:
    """``H:MM:SS``, ``M:SS`` below an hour, and the sign of infinity for negative times."""
    s = F.floor(_c(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(s < 0, "∞").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def clock_time(seconds: str | Column) -> Column:
    """``HH:MM:SS`` of a time span, with as many hours as there are; negative ones count as 0."""
    s = F.greatest(F.floor(_c(seconds)).cast("long"), F.lit(0).cast("long"))
    return F.when(_c(seconds).isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60))


def time_of_day(epoch: str | Column) -> Column:
    """``HH:MM:SS`` of a moment in seconds since 1970, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(_c(epoch)), "HH:mm:ss")


def ago(seconds: str | Column) -> Column:
    s = F.floor(_c(seconds)).cast("long")
    return F.when(s < 60, F.format_string("%ds ago", s)).when(s < 3600, F.format_string("%dm ago", F.floor(s / 60))).otherwise(F.format_string("%dh ago", F.floor(s / 3600)))


def band(value: str | Column, low: float, high: float) -> Column:
    """``ok`` up to ``low``, ``warning`` up to ``high``, else ``critical``."""
    v = _c(value)
    return F.when(v > high, "critical").when(v > low, "warning").when(v.isNotNull(), "ok")


def page_backoff(retries: str | Column) -> Column:
    """Seconds before a page is tried again."""
    return F.pow(F.lit(2.0), _c(retries))


def transport_wait(attempt: str | Column, base: float = 1.0, most: float = 60.0) -> Column:
    """The fixed part of the wait before attempt ``attempt``, counted from 1; jitter is left to who waits."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(most))


def ratio_percent(part: str | Column, whole: str | Column) -> Column:
    """100 part / whole to two decimals; 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(_c(part) * F.lit(100.0), _c(whole)), 2), F.lit(0.0))


# Upper bounds in bytes of small and of medium files.
SMALL_FILE, MEDIUM_FILE = 10 * 1024 * 1024, 50 * 1024 * 1024


def size_tier(size: str | Column) -> Column:
    n = _c(size)
    return F.when(n < SMALL_FILE, "small").when(n < MEDIUM_FILE, "medium").when(n.isNotNull(), "large")


def write_strategy(size: str | Column) -> Column:
    """How a file of that size is written: at once, streamed, or mapped."""
    n = _c(size)
    return F.when(n >= MEDIUM_FILE, "mmap").when(n > SMALL_FILE, "streaming").when(n.isNotNull(), "direct")
