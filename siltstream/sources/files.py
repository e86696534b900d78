"""File readers: text, bytes, compressed Markdown, sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions.text import size_tier


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): one row a line, without line ends; large files are split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): plain and gzip files as one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def file_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, tier) of the files below ``path``; contents are not read."""
    return binaries(spark, path).select(F.col("path").alias("file"), "length", size_tier("length").alias("tier"))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    return binaries(spark, path).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def unpacked(name: str, content: bytes) -> str:
    """The text of a stored page by the ending of its name; invalid bytes are replaced."""
    if name.endswith(".zst"):
        import zstandard

        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    elif name.endswith(".gz"):
        import gzip

        content = gzip.decompress(content)
    return content.decode("utf-8", errors="replace")


def compressed_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of plain, ``.gz`` and ``.zst`` files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unpacked(n, c) for n, c in zip(names, batch.column(1).to_pylist())], pa.string())], ["file", "text"])

    return binaries(spark, path).select("path", "content").mapInArrow(run, "file string, text string")


def process_chunks(df: DataFrame, processor: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Arrow batches of ``df`` through ``processor``: Spark's partitions take the place of chunks of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield processor(batch)

    return df.mapInArrow(run, schema)
