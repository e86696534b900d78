"""Text repeated across the documents of one source (problem 5).

Texts are cut into chunks where a rolling hash of the last WINDOW letters and digits hits a mask; blanks, line ends
and punctuation are not hashed. Distinct documents are counted per chunk and source, and a chunk that too many of a
source's documents hold is repeated. Two results come from such chunks:

* Passages: chunks run across line ends, so a notice is found however it is wrapped, and inside longer lines. Spans
  of repeated chunks are joined and can be cut.
* Lines, as problem 5 asks for them: a label of one word never fills a window, so line ends are chunk ends too, and a
  window does not cross them; the same line then gives the same chunks wherever it stands. Lines that begin with a
  repeated chunk are the candidates, whose whole lines are then counted exactly.

No text is sent to its source: chunk and line hashes travel, salted by document, so a source or line that a third
of all documents share is spread over SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.llm.codes import code_points, gear, letters, parcels, segment_hashes
from siltstream.session import materialize, spread

#: Letters and digits under the rolling hash, and the mask it must miss: chunks of about 64 letters.
WINDOW, MASK = 16, np.uint64(63 << 20)
#: Parts over which the documents of one repeated chunk or line are dealt in joins.
SALTS = 16


def source_key(column: str | Column) -> Column:
    """A site's name for comparison: lower case, without a leading ``www.``."""
    name = F.lower(F.col(column) if isinstance(column, str) else column)
    return F.when(name.startswith("www."), F.substring(name, 5, 1_000_000)).otherwise(name)


class Chunked:
    """The lines and chunks of some texts, as arrays.

    ``line_text`` and ``line_no`` give each line that has letters or digits its text (by place) and number from 1,
    ``line_hash`` its hash by letters and digits, ``line_chunk`` its first chunk (by place). ``chunk_text``,
    ``chunk_line`` and ``chunk_hash`` give each chunk its text, line and hash, ``chunk_first`` and ``chunk_last`` its first and last character
    in the text. With ``lines`` chunks end at line ends and windows do not cross them, else only at ends of texts.
    """

    def __init__(self, texts: list[str], lines: bool = True) -> None:
        codes = code_points("\n".join(texts))
        place = np.flatnonzero(letters()[codes] > 0)
        values = gear()[codes[place]]
        row = np.cumsum(codes == 10)[place]  # number of the line in all the texts, from 0
        rows = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        first_row = np.r_[0, np.cumsum(rows)[:-1]]
        first_place = np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))[:-1]]
        n = len(values)
        text = np.searchsorted(first_row, row, side="right") - 1
        line_starts, line_ends = _segments(row)
        self.line_text = text[line_starts]
        self.line_no = row[line_starts] - first_row[self.line_text] + 1
        self.line_hash = segment_hashes(values, line_starts, line_ends).view(np.int64)
        starts, ends = (line_starts, line_ends) if lines else _segments(text)
        # Sums over windows that double: of 1, 2, 4, 8 and 16 letters.
        rolling, width = values.copy(), 1
        while width < WINDOW:
            rolling[width:] = rolling[width:] + (rolling[:-width] << np.uint64(width))
            width *= 2
        inside = np.arange(n) - np.repeat(starts, ends - starts) >= WINDOW - 1
        last = np.zeros(n, bool)
        last[ends - 1] = True
        chunk_ends = np.flatnonzero((inside & ((rolling & MASK) == 0)) | last) + 1
        chunk_starts = np.r_[0, chunk_ends[:-1]][: len(chunk_ends)]
        self.chunk_text = text[chunk_starts]
        self.chunk_hash = segment_hashes(values, chunk_starts, chunk_ends).view(np.int64)
        self.chunk_first = place[chunk_starts] - first_place[self.chunk_text]
        self.chunk_last = place[chunk_ends - 1] - first_place[self.chunk_text]
        self.chunk_line = np.searchsorted(line_starts, chunk_starts, side="right") - 1
        self.line_chunk = np.searchsorted(chunk_starts, line_starts, side="right") - 1


def _segments(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal ``marks``."""
    if not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, np.diff(marks) != 0])
    return starts, np.r_[starts[1:], len(marks)]


def _documents(df: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(f"`{id_column}`").alias("id"), source_key(f"`{source_column}`").alias("source"), F.col(f"`{text_column}`").alias("text"))


def chunk_counts(docs: DataFrame, lines: bool = True) -> DataFrame:
    """(source, chunk, documents) of (id, source, text): in how many documents of the source each chunk stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in parcels(texts):
                c = Chunked(texts[begin:end], lines)
                if len(c.chunk_hash):
                    # Once a document: sort by (document, chunk) and keep the first of each.
                    by = np.lexsort((c.chunk_hash, c.chunk_text))
                    doc, chunk = c.chunk_text[by], c.chunk_hash[by]
                    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(chunk) != 0)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new] + begin)), pa.array(chunk[new])], ["source", "chunk"])

    chunks = _hashed(docs).select("source", "text")
    return spread(chunks).mapInArrow(run, "source bigint, chunk bigint").groupBy("source", "chunk").agg(F.count("*").alias("documents"))


def _hashed(docs: DataFrame) -> DataFrame:
    """The documents that have a text and a source, the source by its hash."""
    return docs.filter("source IS NOT NULL AND text IS NOT NULL").select("id", F.xxhash64("source").alias("source"), "text")


def _totals(docs: DataFrame) -> DataFrame:
    return docs.filter("source IS NOT NULL").groupBy(F.xxhash64("source").alias("source")).agg(F.count("*").alias("total"))


def repeated_chunks(docs: DataFrame, least: int, share: float, lines: bool = True) -> DataFrame:
    """(source, chunk): the chunks in at least ``least`` documents and ``share`` of all of their source.

    No source has more of them than its documents have chunks on average, divided by ``share``.
    """
    often = chunk_counts(docs, lines).filter(F.col("documents") >= least).join(_totals(docs), "source")
    return materialize(often.filter(F.col("documents") >= share * F.col("total")).select("source", "chunk"), "chunks")


def _kept(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` are among the ``wanted``, of which each is sent to SALTS places."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = wanted.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # The copies grow with the data, so they are never broadcast.
    return salted.join(copies.hint("merge"), [*keys, "salt"], "left_semi").drop("salt")


def repeated_lines(df: DataFrame, id_column: str, source_column: str, text_column: str, least: int = 5, share: float = 0.15) -> DataFrame:
    """(id, line_no) of every line repeated in at least ``least`` documents and ``share`` of all of its source.

    Lines are split at newlines, numbered from 1, and compared by letters and digits in lower case; lines without
    any never count. A document counts once per line. Rows with a null source belong to none; null texts have no
    lines but count as documents. An empty table gives no rows.
    """
    docs = _documents(df, id_column, source_column, text_column)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in parcels(texts):
                c = Chunked(texts[begin:end])
                if len(c.line_no):
                    by = np.lexsort((c.line_no, c.line_hash, c.line_text))
                    first = np.zeros(len(by), bool)
                    first[by] = np.r_[True, (np.diff(c.line_text[by]) != 0) | (np.diff(c.line_hash[by]) != 0)]
                    who = pa.array(c.line_text + begin)
                    columns = [pa.array(c.line_no.astype(np.int32)), pa.array(c.line_hash), pa.array(c.chunk_hash[c.line_chunk]), pa.array(first)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *columns], ["id", "source", "line_no", "line", "chunk", "first"])

    chunks = repeated_chunks(docs, least, share)
    lines = spread(_hashed(docs)).mapInArrow(run, f"id {kind}, source bigint, line_no int, line bigint, chunk bigint, first boolean")
    likely = materialize(_kept(lines, chunks, ["source", "chunk"]).drop("chunk"), "lines")
    counted = likely.groupBy("source", "line").agg(F.count_if("first").alias("documents")).filter(F.col("documents") >= least)
    often = materialize(counted.join(_totals(docs), "source").filter(F.col("documents") >= share * F.col("total")).select("source", "line"), "often")
    return _kept(likely, often, ["source", "line"]).select("id", F.col("line_no").cast("bigint").alias("line_no"))


def repeated_passages(df: DataFrame, id_column: str, source_column: str, text_column: str, least: int = 5, share: float = 0.15) -> DataFrame:
    """(id, first_char, last_char) of the spans, from 0, made of chunks that a source repeats, across line ends.

    Neighbouring repeated chunks of a document are one span. A passage is found but for its first letters (up to a
    window and a chunk), as chunks must fall in step first. Nulls, repeated rows and empty tables as for lines.
    """
    docs = _documents(df, id_column, source_column, text_column)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in parcels(texts):
                c = Chunked(texts[begin:end], lines=False)
                if len(c.chunk_hash):
                    who = pa.array(c.chunk_text + begin)
                    number = np.arange(len(c.chunk_text)) - np.searchsorted(c.chunk_text, c.chunk_text)
                    columns = [pa.array(c.chunk_hash), pa.array(number), pa.array(c.chunk_first), pa.array(c.chunk_last)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *columns], ["id", "source", "chunk", "number", "first_char", "last_char"])

    chunks = repeated_chunks(docs, least, share, lines=False)
    placed = spread(_hashed(docs)).mapInArrow(run, f"id {kind}, source bigint, chunk bigint, number bigint, first_char bigint, last_char bigint")
    cut = _kept(placed, chunks, ["source", "chunk"])
    # Neighbours have the same difference of number and rank; a window holds the chunks of one document.
    run_of = F.col("number") - F.row_number().over(Window.partitionBy("id").orderBy("number"))
    return cut.withColumn("run", run_of).groupBy("id", "run").agg(F.min("first_char").alias("first_char"), F.max("last_char").alias("last_char")).drop("run")


def without_lines(df: DataFrame, id_column: str, text_column: str, cut: DataFrame, into: str = "cleaned") -> DataFrame:
    """(id, ``into``, ``lines_cut``): every text of ``df`` without the lines ``cut`` (id, line_no).

    Null texts stay null. The lines of one document are gathered as one array, never those of a source.
    """
    gone = cut.groupBy("id").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).join(gone, "id", "left")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, count = [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and gone:
                    drop = set(gone)
                    text = "\n".join(line for no, line in enumerate(text.split("\n"), 1) if no not in drop)
                out.append(text)
                count.append(len(gone or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(count, pa.int32())], ["id", into, "lines_cut"])

    return docs.mapInArrow(run, f"id {kind}, `{into}` string, lines_cut int")
