"""The pN_ queries: each takes (spark, folder) and applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.llm import body, leaks, looks, near, packing, pieces, repeats, residue, tokens
from siltstream.session import materialize, spread
from siltstream.sources.tables import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = looks.look_alike_pairs(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form, and whether that differs from what is stored."""
    docs = looks.one_form(table(spark, folder, "documents", "doc_id", "text"))
    return docs.select("doc_id", "canonical", (F.col("canonical") != F.col("text")).alias("changed"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "content")
    return body.lines_outside(items, "item_id", "content").withColumnRenamed("id", "item_id")


def p1_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every item."""
    items = table(spark, folder, "scraped_items", "item_id", "content")
    return body.main_body(items, "item_id", "content").withColumnRenamed("id", "item_id")


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    items = residue.residue(table(spark, folder, "scraped_items", "item_id", "content"), "item_id", "content")
    errors = residue.residue(table(spark, folder, "urls", "url", "last_error"), "url", "last_error", residue.residue_of_error)
    named = items.select(F.lit("item").alias("origin"), F.col("item_id").cast("string").alias("record_key"), "reason")
    return named.unionAll(errors.select(F.lit("url").alias("origin"), F.col("url").alias("record_key"), "reason"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).filter("record_key IS NOT NULL").select("origin", "record_key").distinct()


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many records are residue, by origin and reason."""
    return _residue(spark, folder).groupBy("origin", "reason").agg(F.count("*").alias("records"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "content", "content_type", "metadata.headers")
    return pieces.pieces(items, table(spark, folder, "split_limits"), headers_column="headers").withColumnRenamed("id", "item_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).filter("piece_no = 1 AND pieces > 1").select("item_id")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered pieces of every oversized item."""
    return _pieces(spark, folder)


def p3_joined(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each oversized item give when joined from their cuts, and whether all keep their limit."""
    limits = table(spark, folder, "split_limits")
    items = table(spark, folder, "scraped_items", "item_id", "content_type")
    known = items.join(limits.select("content_type", F.lit(True).alias("known")).distinct(), "content_type", "left")
    kinds = known.select("item_id", F.when(F.col("known"), F.col("content_type")).otherwise("text").alias("content_type"))
    size = F.when(F.col("size_unit") == "bytes", F.octet_length("piece")).otherwise(F.char_length("piece"))
    each = _pieces(spark, folder).join(kinds, "item_id").join(limits, "content_type")
    part = F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("own"))
    joined = each.groupBy("item_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_and(size <= F.col("max_size")).alias("within"))
    return joined.select("item_id", F.md5(F.array_join(F.transform("parts", lambda p: p["own"]), "")).alias("digest"), "within")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "content")
    pairs, members = near.near_duplicates(items, "item_id", "content", width=3, threshold=0.6, least_words=60)
    found = near.direct_pairs(pairs, members)
    return found.select(F.col("id_a").alias("item_id_a"), F.col("id_b").alias("item_id_b"))


def p4_linked(spark: SparkSession, folder: str) -> DataFrame:
    """The links of ``p4_found`` between different texts, each text by its representative (the least id of its copies)."""
    items = table(spark, folder, "scraped_items", "item_id", "content")
    pairs, _ = near.near_duplicates(items, "item_id", "content", width=3, threshold=0.6, least_words=60)
    return pairs.select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"), "jaccard")


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """The representative of every item with at least 60 words: with ``p4_linked``, all that ``p4_found`` says."""
    items = table(spark, folder, "scraped_items", "item_id", "content")
    _, members = near.near_duplicates(items, "item_id", "content", width=3, threshold=0.6, least_words=60)
    return members.select(F.col("id").alias("item_id"), F.col("rep").alias("representative"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicates by the usual five words and 0.8: every item with its class."""
    items = table(spark, folder, "scraped_items", "item_id", "content")
    found = near.classes(*near.near_duplicates(items, "item_id", "content"))
    return found.withColumnRenamed("id", "item_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "scraped_items", "item_id", "domain", "content")
    return repeats.repeated_lines(items, "item_id", "domain", "content").withColumnRenamed("id", "item_id")


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every item's content without the lines its domain repeats."""
    items = table(spark, folder, "scraped_items", "item_id", "domain", "content")
    cut = repeats.repeated_lines(items, "item_id", "domain", "content")
    return repeats.without_lines(items, "item_id", "content", cut).withColumnRenamed("id", "item_id")


def p5_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The passages, however wrapped, that a domain repeats in its items."""
    items = table(spark, folder, "scraped_items", "item_id", "domain", "content")
    return repeats.repeated_passages(items, "item_id", "domain", "content").withColumnRenamed("id", "item_id")


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of documents by source, language and domain, and of scraped_items by domain."""
    docs = table(spark, folder, "documents", "text", "lang", "source", "domain")
    items = table(spark, folder, "scraped_items", "content", "domain")
    by_all = tokens.token_totals(docs, "text", tokens.document_keys())
    by_domain = tokens.token_totals(items, "content", {"domain": tokens.document_keys()["domain"]})
    none = F.lit(None).cast("string")
    by_domain = by_domain.select(F.lit("scraped_items").alias("origin"), none.alias("source"), none.alias("lang"), *by_domain.columns)
    return by_all.select(F.lit("documents").alias("origin"), *by_all.columns).unionByName(by_domain)


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What ``p6_totals`` says but for the tokens: documents, distinct texts and characters by the same keys."""
    return p6_totals(spark, folder).drop("tokens")


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    docs = table(spark, folder, "documents", "doc_id", "text")
    texts = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sized = materialize(tokens.count_tokens(spread(texts)).withColumnRenamed("key", "id"), "sized")
    specs = packing.capacities(table(spark, folder, "pack_specs"), "spec_name", "capacity_tokens")
    return packing.pack(sized, specs), specs


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a container of each capacity."""
    return _packed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What a packing must keep, by capacity: all documents, none over capacity, every token of a document once."""
    packed, specs = _packed(spark, folder)
    capacity = F.element_at(F.create_map(*[F.lit(x) for pair in specs.items() for x in pair]), F.col("spec_name"))
    full = packed.filter("container_id IS NOT NULL").groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("held"))
    over = full.groupBy("spec_name").agg(F.count_if(F.col("held") > capacity).alias("over_capacity"))
    # Pieces tile a document if the ends of all but the last are the starts of all but the first.
    tiled = F.sum(F.col("first_token") + F.col("tokens")) - F.max(F.col("first_token") + F.col("tokens")) == F.sum("first_token") - F.min("first_token")
    # A document is cut only where it alone exceeds the capacity.
    cut = (F.count("*") > 1) & (F.sum("tokens") <= F.first(capacity))
    docs = packed.groupBy("spec_name", "id").agg((tiled & (F.min("first_token") == 0) & (F.count("*") == F.max("piece_no"))).alias("tiled"), cut.alias("cut"))
    kept = docs.groupBy("spec_name").agg(F.count("*").alias("documents"), F.count_if(~F.col("tiled")).alias("broken"), F.count_if("cut").alias("cut_in_vain"))
    return kept.join(over, "spec_name", "left")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_rates(*_packed(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "eval_id", "text")
    return leaks.leaked_spans(docs, "doc_id", "text", items, "eval_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, folder)).withColumnRenamed("item_id", "eval_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of words to remove from each affected document."""
    return _leaks(spark, folder).withColumnRenamed("item_id", "eval_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_bodies": p1_bodies,
        "p2_found": p2_found,
        "p2_reasons": p2_reasons,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p3_joined": p3_joined,
        "p4_found": p4_found,
        "p4_linked": p4_linked,
        "p4_members": p4_members,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_cleaned": p5_cleaned,
        "p5_passages": p5_passages,
        "p6_totals": p6_totals,
        "p6_counts": p6_counts,
        "p7_packed": p7_packed,
        "p7_whole": p7_whole,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_spans": p8_spans,
        "p9_found": p9_found,
        "p9_texts": p9_texts,
    }
