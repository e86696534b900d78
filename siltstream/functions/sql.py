"""The Python functions under names for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from siltstream.functions.text import repair_text
from siltstream.functions.urls import join_url, normalize_one, slugify


@udtf(returnType="href string, kind string")
class PageLinks:
    """The links and images of an HTML text, as a table."""

    def eval(self, html: str) -> Iterator[tuple[str, str]]:
        from siltstream.html.dom import parse

        if html:
            root = parse(html)
            for node in root.find_all("a"):
                if node.attrs.get("href"):
                    yield node.attrs["href"], "link"
            for node in root.find_all("img"):
                if node.attrs.get("src"):
                    yield node.attrs["src"], "image"


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: slugify, normalize_url, join_url, repair_text, and the table page_links."""
    for name, function in {"slugify": slugify, "normalize_url": normalize_one, "join_url": join_url, "repair_text": repair_text}.items():
        spark.udf.register(name, function)
    spark.udtf.register("page_links", PageLinks)
