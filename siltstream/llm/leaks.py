"""Evaluation texts inside training texts (problem 8).

Each Arrow partition of the corpus is cut into shards of whole texts, and an FM-index is built over the words of
each shard. All phrases of ``length`` words of the evaluation texts are searched backwards in it at once, their
occurrences are located through sampled suffix positions, and the spans of one evaluation text in one document
that touch are merged. Words are maximal runs of letters and digits in lower case, of the text in its one form
(see ``looks``), so punctuation, markup and line breaks between words do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.fmindex import FMIndex
from siltstream.llm.looks import Looks
from siltstream.session import spread

#: Consecutive words that make a leak.
LENGTH = 12
#: Words of a shard: bounds a task's memory, whatever the size of its partition.
SHARD_WORDS = 1_000_000
#: Words of evaluation texts in a block. Blocks are searched one after the other in each shard's one index.
BLOCK_WORDS = 200_000

WORD = re.compile(r"[^\W_]+")
#: Tags and the targets of links stand between words and are not words of the text.
MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*>|\]\([^()\s]*\)|&[a-zA-Z]{2,31};")


def words_of(text: str) -> list[str]:
    if "<" in text or "](" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.lower())


def phrase_table(texts: list[tuple[object, list[str]]], length: int) -> tuple[np.ndarray, list[str], np.ndarray, list]:
    """Distinct phrases as rows of word numbers, the words by number, (phrase, text) pairs of where each stands, and ids."""
    number: dict[str, int] = {}
    rows: dict[tuple[int, ...], int] = {}
    pairs, ids = set(), [key for key, _ in texts]
    for k, (_, words) in enumerate(texts):
        coded = [number.setdefault(w, len(number)) for w in words]
        for i in range(len(coded) - length + 1):
            pairs.add((rows.setdefault(tuple(coded[i : i + length]), len(rows)), k))
    phrases = np.array(list(rows), dtype=np.int64).reshape(len(rows), length)
    where = np.array(sorted(pairs), dtype=np.int64).reshape(len(pairs), 2)
    return phrases, list(number), where, ids


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """The evaluation texts in blocks of BLOCK_WORDS, read one partition at a time."""
    looks, block, size = Looks(), [], 0
    for row in items.toLocalIterator():
        form = looks.form(pa.array([row["text"]], pa.string()))[0].as_py()
        words = words_of(form)
        block.append((row["id"], words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, length: int = LENGTH) -> DataFrame:
    """(``doc_id``, ``item_id``, ``first_word``, ``last_word``): merged spans of words, counted from 0.

    Null and short texts hold no phrase and give no rows; repeated evaluation texts each give their rows; empty
    tables give an empty result. A document of any length is searched as a whole.
    """
    corpus = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{doc_text}`").alias("text")).filter("text IS NOT NULL")
    asked = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("text IS NOT NULL")
    doc_kind, item_kind = (x.schema["id"].dataType.simpleString() for x in (corpus, asked))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, first_word bigint, last_word bigint"
    context, corpus = docs.sparkSession.sparkContext, spread(corpus)
    blocks = [context.broadcast(phrase_table(block, length)) for block in _blocks(asked)]
    return corpus.mapInArrow(_searcher(blocks, length, corpus, asked), schema)


def _searcher(blocks, length, corpus, asked):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([
        ("doc_id", to_arrow_type(corpus.schema["id"].dataType)), ("item_id", to_arrow_type(asked.schema["id"].dataType)),
        ("first_word", pa.int64()), ("last_word", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks, ids, coded, number, size = Looks(), [], [], {}, 0
        for batch in batches:
            forms = looks.form(batch.column(1)).to_pylist()
            for key, form in zip(batch.column(0).to_pylist(), forms):
                words = words_of(form)
                if len(words) >= length:
                    ids.append(key)
                    coded.append(np.fromiter((number.setdefault(w, len(number) + 2) for w in words), np.int64, len(words)))
                    size += len(words) + 1
                    if size >= SHARD_WORDS:
                        yield from search(ids, coded, number)
                        ids, coded, number, size = [], [], {}, 0
        if ids:
            yield from search(ids, coded, number)

    def search(ids, coded, number):
        """What a shard of texts, coded by the numbers of its own words, holds of all blocks."""
        lengths = np.array([len(c) for c in coded])
        starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        index = None
        for block in blocks:
            phrases, words, where, item_ids = block.value
            if len(blocks) > 1:
                # One block in memory at a time; the next shard reads it from the worker's disk again.
                block.__dict__.pop("_value", None)
            asked = np.fromiter((number.get(w, 0) for w in words), np.int64, len(words))[phrases]
            rows = np.flatnonzero((asked > 0).all(axis=1))
            if not len(rows):
                continue
            if index is None:
                text = np.ones(int(lengths.sum()) + len(lengths), np.int64)
                for start, c in zip(starts, coded):
                    text[start : start + len(c)] = c
                index = FMIndex(text)
            lo, hi = index.search(asked[rows])
            counts = hi - lo
            hit = np.flatnonzero(counts)
            if not len(hit):
                continue
            counts = counts[hit]
            ends = np.cumsum(counts)
            places = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(lo[hit], counts)
            position = index.locate(places)
            phrase = np.repeat(rows[hit], counts)
            # Each phrase stands in one or several evaluation texts.
            begin, end = np.searchsorted(where[:, 0], phrase), np.searchsorted(where[:, 0], phrase, side="right")
            each = end - begin
            total = np.cumsum(each)
            item = where[np.arange(total[-1]) - np.repeat(total - each, each) + np.repeat(begin, each), 1]
            position = np.repeat(position, each)
            doc = np.searchsorted(starts, position, side="right") - 1
            first = position - starts[doc]
            by = np.lexsort((first, item, doc))
            doc, item, first = doc[by], item[by], first[by]
            new = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(first) > length)]
            opens = np.flatnonzero(new)
            closes = np.r_[opens[1:], len(first)] - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[d] for d in doc[opens]], arrow[0].type), pa.array([item_ids[i] for i in item[opens]], arrow[1].type),
                    pa.array(first[opens]), pa.array(first[closes] + length - 1),
                ],
                schema=arrow,
            )

    return run


def leaked_items(spans: DataFrame) -> DataFrame:
    """Each document with each evaluation text it holds a phrase of."""
    return spans.select("doc_id", "item_id").distinct()
