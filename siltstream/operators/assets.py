"""Routing of downloaded files, and text from those that hold text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions.text import present, write_strategy
from siltstream.functions.urls import slugify
from siltstream.html.meta import ENGINE

# Endings of documents; all other files count as images. Office formats have no reader here.
DOCUMENTS = (".pdf", ".docx", ".pptx", ".xlsx", ".md", ".txt", ".csv")
OFFICE = (".pdf", ".docx", ".pptx", ".xlsx")


def _last(url: str | Column) -> Column:
    return F.substring_index(F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"/+\z", ""), "/", -1)


def extension(url: str | Column) -> Column:
    """The ending of the address in lower case with its dot, a query string included; '' without one."""
    return F.lower(F.regexp_extract(_last(url), r"^.+(\.[^.]+)\z", 1))


def stem(url: str | Column) -> Column:
    last = _last(url)
    return F.when(last.rlike(r"^.+\.[^.]+\z"), F.regexp_replace(last, r"\.[^.]+\z", "")).otherwise(last)


def folder(url: str | Column) -> Column:
    return F.when(extension(url).isin(*DOCUMENTS), "docs").otherwise("images")


def file_name(url: str | Column) -> Column:
    return F.concat(slugify(present(stem(url), "asset")), extension(url))


def routed(assets: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """Each asset's file name, ending, folder, size, way of writing, and the text or the error of its conversion.

    Markdown files are wrapped in frontmatter; office formats give an error, as no reader for them is installed.
    """
    ext, size = extension(url), F.octet_length(content)
    head = F.concat(
        F.lit("---\nurl: "), F.col(url), F.lit("\nfilename: "), F.col("filename"), F.lit(f"\nformat: MARKDOWN\ningestion_engine: {ENGINE}\n---\n\n"),
        F.make_valid_utf8(F.col(content).cast("string")),
    )
    named = assets.withColumns({"filename": file_name(url), "extension": ext, "folder": folder(url), "size_bytes": size, "strategy": write_strategy(size)})
    return named.withColumns({
        "markdown": F.when(F.col("extension") == ".md", head),
        "conversion_error": F.when(F.col("extension").isin(*OFFICE), F.concat(F.lit("no reader for "), F.col("extension"))),
    })
