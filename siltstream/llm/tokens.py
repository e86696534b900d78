"""Token totals by source, language and domain (problem 6).

Whole texts are hashed and deduplicated, each distinct text is tokenized once with an existing tokenizer, and its
count is joined back to every document that holds it before the totals are summed.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.repeats import source_key

#: Where the vocabulary files lie; they are read there and never copied.
VOCABULARIES = os.environ.get("SILTSTREAM_TOKENIZERS", "/opt/tokenizers")
#: The tokenizer used unless another is named: byte-level BPE for many languages.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"

# Two-letter codes of languages by their other codes and names.
LANGUAGES = {
    "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl",
    "english": "en", "español": "es", "spanish": "es", "français": "fr", "french": "fr", "deutsch": "de", "german": "de",
}


def counter(name: str = TOKENIZER, folder: str = VOCABULARIES, pattern: str | None = None) -> Callable[[str], int]:
    """A function that counts the tokens of a text under the tokenizer file ``name``; stray surrogates count as ``?``.

    Ranks need the ``pattern`` that splits a text; by default it is the one that the folder states as PATTERN.
    """
    count = _counter(name, folder, pattern)
    return lambda text: count(text.encode("utf-8", "replace").decode("utf-8"))


def _counter(name: str, folder: str, pattern: str | None) -> Callable[[str], int]:
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        encoding = tiktoken.Encoding(name, pat_str=pattern or _pattern(folder), mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(pieces.encode(text))


def _pattern(folder: str) -> str:
    """The split pattern that the vocabulary's folder states, read as a constant; nothing there is run."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as source:
        tree = ast.parse(source.read())
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
            return ast.literal_eval(node.value)
    raise ValueError(f"{folder} states no pattern; pass one")


def count_tokens(texts: DataFrame, name: str = TOKENIZER, folder: str = VOCABULARIES, pattern: str | None = None) -> DataFrame:
    """(``key``, tokens) of (key, text). The tokenizer is loaded once a task."""
    texts = texts.select("key", "text")
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(name, folder, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["key", "tokens"])

    return texts.mapInArrow(run, f"key {kind}, tokens bigint")


def language_key(column: str | Column) -> Column:
    """A language by its two-letter code: region, case and three-letter codes do not matter; blank is null."""
    code = F.split(F.lower(F.trim(F.col(column) if isinstance(column, str) else column)), "[-_]")[0]
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.nullif(F.coalesce(F.try_element_at(known, code), code), F.lit(""))


def name_key(column: str | Column) -> Column:
    """A source's name without case, outer blanks, and differences of blank, hyphen and underscore; blank is null."""
    name = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"[\s\-_.]+", "_"), "^_+|_+$", ""), F.lit(""))


def token_totals(df: DataFrame, text_column: str, keys: dict[str, Column], name: str = TOKENIZER, folder: str = VOCABULARIES, pattern: str | None = None) -> DataFrame:
    """(keys..., documents, distinct_texts, characters, tokens): one row for each combination of ``keys``.

    ``tokens`` counts every document, its copies included. Null and empty texts count as documents of 0 tokens; null
    keys are a group of their own. An empty table gives no rows.
    """
    docs = df.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{text_column}`").alias("_text"))
    docs = docs.withColumn("_hash", F.when(F.col("_text") != "", F.unhex(F.md5("_text"))))
    # One row for each text and combination, with its number of copies: all that the second shuffle carries.
    copies = docs.groupBy(*keys, "_hash").agg(F.count("*").alias("_copies"), F.max(F.char_length("_text")).alias("_chars"))
    # Copies meet within their task before anything is sent, so a hot text is sent once a task.
    distinct = docs.filter("_hash IS NOT NULL").groupBy("_hash").agg(F.first("_text").alias("text"))
    counted = count_tokens(distinct.withColumnRenamed("_hash", "key"), name, folder, pattern).withColumnRenamed("key", "_hash")
    joined = copies.join(counted, "_hash", "left")
    return joined.groupBy(*keys).agg(
        F.sum("_copies").alias("documents"),
        F.count("_hash").alias("distinct_texts"),
        F.sum(F.coalesce(F.col("_copies") * F.col("_chars"), F.lit(0))).alias("characters"),
        F.sum(F.coalesce(F.col("_copies") * F.col("tokens"), F.lit(0))).alias("tokens"),
    )


def document_keys(source: str = "source", language: str = "lang", domain: str = "domain") -> dict[str, Column]:
    return {"source": name_key(source), "lang": language_key(language), "domain": F.nullif(source_key(F.trim(F.col(domain))), F.lit(""))}
