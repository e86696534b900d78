"""Cutting oversized texts at natural boundaries (problem 3).

Boundaries are places where a cut costs little: before a heading (least if the page's own list of headings names
it), after a blank line, at the end of a line, of a sentence, before a word; anywhere costs most. A dynamic programme
over the boundaries chooses the cuts with the least sum of cut penalties and of squared shares of the limit that
the pieces leave unused or differ by, where each piece, with the overlap it repeats from the one before, keeps the
limit. Pieces after the first begin ``overlap`` characters before their cut.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.session import spread

#: Penalties of a cut by kind of boundary, from a named heading down to the middle of a word.
NAMED, HEADING, BLANK, LINE, SENTENCE, WORD, ANYWHERE = 0.0, 0.1, 0.3, 0.7, 1.5, 4.0, 25.0
#: Penalty of a cut inside a code block or table, on top.
INSIDE = 3.0
#: Weight of a piece's squared deviation from the even size, in shares of the limit.
BALANCE = 2.0

HEAD_LINE = re.compile(r"^ {0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)
BLANK_LINES = re.compile(r"\n[ \t]*\n\s*")
LINE_END = re.compile(r"\n")
SENTENCE_END = re.compile(r"[.!?…][\"'”»)\]]*\s+")
SPACE = re.compile(r"\s+")
BLOCK = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)|^(?:\|[^\n]*\|[ \t]*\n?){2,}", re.M | re.S)


def boundaries(text: str, headings: set[str] | None = None) -> dict[int, float]:
    """The least penalty of a cut at each boundary of ``text``; headings in step with the text or not do no harm."""
    found: dict[int, float] = {}

    def mark(at: int, cost: float) -> None:
        if 0 < at < len(text) and cost < found.get(at, math.inf):
            found[at] = cost

    for pattern, cost in ((SENTENCE_END, SENTENCE), (LINE_END, LINE), (BLANK_LINES, BLANK)):
        for m in pattern.finditer(text):
            mark(m.end(), cost)
    places = sorted(found)
    for m in BLOCK.finditer(text):
        for at in places[bisect_right(places, m.start()) : bisect_left(places, m.end())]:
            found[at] += INSIDE
    for m in HEAD_LINE.finditer(text):
        mark(m.start(), NAMED if headings and m.group(1).strip().lower() in headings else HEADING)
    return found


def _sizes(text: str, unit: str) -> np.ndarray:
    """The size of each prefix of ``text``: in code points, or in bytes of UTF-8."""
    if unit != "bytes":
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    each = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return np.r_[0, np.cumsum(each)]


def cut(text: str, limit: int, unit: str = "chars", overlap: int = 0, headings: set[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, cut, end) of the pieces: a piece is text[start:end], of which text[start:cut] repeats the one before.

    A text within the limit is one piece. Every piece is at most ``limit`` in ``unit``; joined from their cuts they
    give the text back. The overlap counts in the limit, so it is below that (``limits_of`` refuses others). An overlap
    whose bytes leave less than a quarter of the room beside it is shortened at that cut, and only there.
    """
    sizes = _sizes(text, unit)
    total = int(sizes[-1])
    if total <= limit:
        return [(0, 0, len(text))]
    if limit < (4 if unit == "bytes" else 1):
        raise ValueError("a limit below one character")
    widest = int(np.diff(sizes).max())
    overlap = max(0, min(overlap, limit - 1))
    # Where the repeated part of a piece begins, for a cut at each place.
    most = limit - max(widest, (limit - overlap) // 4)
    before = np.maximum(np.arange(len(sizes)) - overlap, 0)
    before = np.maximum(before, np.searchsorted(sizes, sizes - most))
    room = limit - int((sizes - sizes[before]).max())
    costs = boundaries(text, headings)
    # Long sentences may be cut before words, long words anywhere, so that every stretch can be bridged.
    stride = max(1, room // (2 * widest))
    last = 0
    for at in [*sorted(costs), len(text)]:
        if at - last > stride:
            costs |= {m.end(): WORD for m in SPACE.finditer(text, last + 1, at) if last < m.end() < at}
        last = at
    last = 0
    for at in [*sorted(costs), len(text)]:
        while at - last > stride:
            last += stride
            costs[last] = ANYWHERE
        last = at
    places = np.array([0, *sorted(costs), len(text)])
    penalty = np.array([0.0, *(costs[p] for p in places[1:-1].tolist()), 0.0])
    starts = before[places]
    begin, size_at = sizes[starts], sizes[places]
    # The even size of a piece, if as few pieces as can be are made.
    step = max(1, limit - overlap)
    even = min(limit, total / math.ceil(total / step) + overlap)
    best = np.full(len(places), np.inf)
    came = np.zeros(len(places), np.int64)
    best[0], low = 0.0, 0
    for j in range(1, len(places)):
        while size_at[j] - begin[low] > limit:
            low += 1
        reach = np.arange(low, j)
        filled = (size_at[j] - begin[low:j]) / limit
        cost = best[low:j] + penalty[j] + 1.0 + BALANCE * (filled - even / limit) ** 2
        k = int(np.argmin(cost))
        best[j], came[j] = cost[k], reach[k]
    ends = [len(places) - 1]
    while ends[-1]:
        ends.append(int(came[ends[-1]]))
    ends.reverse()
    return [(int(starts[a]), int(places[a]), int(places[b])) for a, b in zip(ends[:-1], ends[1:])]


def limits_of(limits: DataFrame, default: str = "text") -> dict[str, tuple[int, str, int]]:
    """The limits by content type: one row a type, read to the driver and held to MOST_TYPES."""
    rows = limits.select("content_type", "max_size", "size_unit", "overlap_chars").dropna(subset=["content_type", "max_size"]).limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} content types")
    found = {r["content_type"]: (r["max_size"], r["size_unit"] or "chars", r["overlap_chars"] or 0) for r in rows}
    for kind, (most, _, overlap) in found.items():
        if overlap >= most:
            raise ValueError(f"an overlap of {overlap} leaves no room under the limit {most} of {kind}")
    if rows and default not in found:
        raise ValueError(f"no limit for the default type {default}")
    return found


#: Content types with a limit of their own; a table of settings, not of data.
MOST_TYPES = 10_000


def pieces(df: DataFrame, limits: DataFrame, id_column: str = "item_id", text_column: str = "content", type_column: str = "content_type", headers_column: str | None = "metadata.headers", default: str = "text", whole: bool = False) -> DataFrame:
    """(id, piece_no, pieces, start, overlap, end, piece): the pieces of each text above its type's limit.

    Offsets are code points; ``overlap`` is how many of them the piece repeats. Null and unlisted types use the row
    ``default``. Null and empty texts have no pieces. With ``whole`` texts within the limit are given too, as one
    piece. A text exactly at the limit is within it. Headers may be null, empty or out of step with the text.
    """
    known = limits_of(limits, default)
    texts = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{type_column}`").alias("type"),
        (F.col(f"{headers_column}.text") if headers_column else F.lit(None).cast("array<string>")).alias("headings"),
    ).filter("text IS NOT NULL AND text <> ''")
    schema = T.StructType([
        T.StructField("id", texts.schema["id"].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("overlap", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("piece", T.StringType()),
    ])
    if not known:
        return df.sparkSession.createDataFrame([], schema)
    # Only texts above their limit go to Python: the test is a comparison in the JVM.
    limit = {k: F.create_map(*[x for t, v in known.items() for x in (F.lit(t), F.lit(v[k]))]) for k in (0, 1)}
    kind = F.when(F.map_contains_key(limit[0], F.coalesce("type", F.lit(default))), F.coalesce("type", F.lit(default))).otherwise(F.lit(default))
    texts = texts.withColumn("type", kind)
    if not whole:
        size = F.when(F.element_at(limit[1], F.col("type")) == "bytes", F.octet_length("text")).otherwise(F.char_length("text"))
        texts = texts.filter(size > F.element_at(limit[0], F.col("type")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in range(6)]
            for row, (text, type_, headings) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                most, unit, overlap = known[type_]
                named = {h.strip().lower() for h in headings or () if h}
                found = cut(text, most, unit, overlap, named)
                for no, (start, at, end) in enumerate(found, 1):
                    rows.append(row)
                    for column, value in zip(out, (no, len(found), start, at - start, end, text[start:end])):
                        column.append(value)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(out, types))], schema.names)

    return spread(texts).mapInArrow(run, schema)
