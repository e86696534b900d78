"""Sinks: validated items with a dead-letter side, pages as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# What an item must have.
REQUIRED = ("url", "content", "domain")


def validation_errors(required: tuple[str, ...] = REQUIRED, rules: dict[str, Column] | None = None) -> Column:
    """What is wrong with a row: required columns that are null, and rules that do not hold."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in required]
    checks += [F.when(~F.coalesce(rule, F.lit(False)), F.lit(f"{name}: invalid")) for name, rule in (rules or {}).items()]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


# Bounds of a page's title, and the endings of stored Markdown.
def page_input_rules(url: str = "url", title: str = "title", path: str = "content_md_path") -> dict[str, Column]:
    return {
        "url": F.col(url).rlike("^https?://"),
        "title": F.char_length(F.trim(title)).between(1, 500),
        "content_md_path": F.col(path).rlike(r"\.md(\.zst|\.gz)?\z"),
    }


def split_valid(items: DataFrame, required: tuple[str, ...] = REQUIRED, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid items, failed items as (original_data, validation_error)): each row is in exactly one."""
    judged = items.withColumn("_errors", validation_errors(required, rules))
    valid = judged.filter(F.size("_errors") == 0).drop("_errors")
    failed = judged.filter(F.size("_errors") > 0).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns])).alias("original_data"), F.array_join("_errors", "; ").alias("validation_error"))
    return valid, failed


def write_items(
    items: DataFrame, folder: str, kind: str = "json", rows_per_file: int = 0, required: tuple[str, ...] = REQUIRED, rules: dict[str, Column] | None = None, batch: int | None = None,
) -> dict[str, int]:
    """Append the valid items to ``folder/items`` and the others to ``folder/failed``; how many each took.

    Spark's commit makes a write whole or absent, and appending keeps earlier batches. A ``batch`` has a partition of
    its own, which it replaces when it comes again.
    """
    valid, failed = split_valid(items, required, rules)
    counts = {}
    for name, part in (("items", valid), ("failed", failed)):
        seen = Observation(name)
        writer = part.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if batch is None else "overwrite").option("maxRecordsPerFile", rows_per_file)
        place = f"{folder}/{name}" if batch is None else f"{folder}/{name}/batch={batch}"
        writer.format("json" if name == "failed" else kind).save(place)
        counts[name] = seen.get["n"]
    return counts


def packed(text: str, codec: str) -> bytes:
    """A page's bytes: ``zstd`` at level 3, ``gzip`` at level 6, or ``none``."""
    data = text.encode("utf-8")
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(data)
    if codec == "gzip":
        import gzip

        return gzip.compress(data, 6, mtime=0)
    if codec == "none":
        return data
    raise ValueError(f"unknown codec {codec!r}")


def unpacked(data: bytes, codec: str) -> str:
    """The text of a page's bytes."""
    if codec == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data)
    elif codec == "gzip":
        import gzip

        data = gzip.decompress(data)
    return data.decode("utf-8")


ENDINGS = {"zstd": ".md.zst", "gzip": ".md.gz", "none": ".md"}


def packed_pages(pages: DataFrame, key: str, text: str, codec: str = "zstd") -> DataFrame:
    """(key, data, original, compressed): every text compressed, with its sizes in bytes; null texts are empty."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            data = [packed(t, codec) for t in texts]
            sizes = [[len(t.encode()) for t in texts], [len(d) for d in data]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), *(pa.array(s, pa.int64()) for s in sizes)], ["key", "data", "original", "compressed"])

    return pages.select(key, text).mapInArrow(run, f"key {kind}, data binary, original bigint, compressed bigint")


def export_pages(pages: DataFrame, name: str, text: str, folder: str, codec: str = "zstd") -> None:
    """One file a page, for those who need files; two pages of one name are told apart by a hash of their address.

    ``pages`` needs the column ``url``. The executors write the files themselves, so ``folder`` must be one that all of
    them mount; an address of another file system is refused. Tables are better kept as Parquet, which compresses with
    zstd by itself.
    """
    if "://" in folder:
        raise ValueError("files are written to a mounted folder; write a table to other file systems")
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.left(F.md5("url"), F.lit(8)))).otherwise("")
    counts = pages.groupBy(F.col(name).alias("_name")).agg(F.countDistinct("url").alias("_n"))
    named = pages.join(counts, pages[name] == counts["_name"]).select(F.concat(F.col(name), suffix).alias("name"), F.col(text).alias("text"))
    ending = ENDINGS[codec]

    def write(rows: Iterator) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = os.path.join(folder, row["name"] + ending)
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(packed(row["text"] or "", codec))
            os.replace(part, path)

    named.foreachPartition(write)
