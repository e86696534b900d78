"""A crawl over pages that are already there: rounds of fetch, gate, parse, store and follow.

Each round is one plan: the pending addresses joined with the pages, gated by cheap columns first, parsed in one pass,
and turned into status changes, items and newly discovered addresses. The store is written between rounds; a round ends
the mission when nothing is pending.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.operators import frontier, gating, state
from siltstream.operators.pages import parse_pages
from siltstream.session import materialize, release

STORE = "url string, status string, type string, retries int, last_error string, last_try timestamp, discovered_at timestamp"


@dataclass
class Mission:
    """What a mission leaves: the store, the extracted items, and the number of rounds."""

    store: DataFrame
    items: DataFrame
    rounds: int


def seeded(seeds: DataFrame) -> DataFrame:
    """A store of the seeds (url), pending as webpages."""
    empty = seeds.sparkSession.createDataFrame([], STORE)
    rows = seeds.select("url", F.lit("pending").alias("status"), F.lit("webpage").alias("type"), F.lit(0).alias("retries"))
    return state.insert_ignore(empty, rows, F.lit(0))[0]


def run(pages: DataFrame, store: DataFrame, robots: DataFrame | None = None, scope: str = "smart", most_retries: int = 3, assets: DataFrame | None = None, between: Callable[[DataFrame, int], bool] | None = None) -> Mission:
    """Crawl ``pages`` (url, status, html) from the pending addresses of ``store``.

    An address without a page fails as not found. Forbidden ones become ``skipped_robots``; challenge pages and error
    responses fail with a retry counted, so they are tried again in the next rounds while tries are left. Every page is
    taken once an address; of repeated rows any one. Rounds go on until nothing is pending: each address that is taken
    is completed, skipped or has a try less. Stored pages do not change, so no round waits before it tries again.

    ``between`` is asked before each round, with the store and the number of rounds done, whether to go on; a mission
    that ends so leaves addresses pending, and another goes on from its store.

    With ``assets`` (url, content), the assets found are completed where there is a content, else failed; without, they
    stay pending for another job.
    """
    pages = materialize(pages.select("url", "status", "html").dropDuplicates(["url"]), "pages")
    store, items, rounds = materialize(store, "store"), None, 0
    before: DataFrame | None = None
    while True:
        waiting = state.pending(store, "webpage", most_retries).select("url")
        if (between is not None and not between(store, rounds)) or waiting.isEmpty():
            break
        rounds += 1
        at = F.lit(datetime.now(timezone.utc))
        # Addresses alone pass the robots gate; only the pages of those it lets through are joined.
        gated = gating.robots_gate(waiting, robots) if robots is not None else waiting.withColumn("allowed", F.lit(True))
        gated = gated.join(pages.withColumnRenamed("status", "code").withColumn("allowed", F.lit(True)), ["url", "allowed"], "left")
        kind = gating.response_class("code")
        error = (
            F.when(~F.col("allowed"), "robots").when(F.col("code").isNull(), "HTTP 404").when(kind == "empty", "Empty content")
            .when(kind != "ok", F.concat(F.lit("HTTP "), F.col("code").cast("string"))).when(gating.challenge("html").isNotNull(), F.concat(F.lit("Challenge: "), gating.challenge("html")))
        )
        judged = materialize(gated.withColumn("error", error), "judged")
        good = judged.filter("error IS NULL")
        parsed = materialize(parse_pages(good, keep=("url",), parts=("metadata", "markdown", "engine", "links", "images")), "parsed")
        new_items = parsed.select("url", "metadata.title", "markdown", "engine")
        items = new_items if items is None else items.unionAll(new_items)
        if rounds % frontier.TOGETHER == 0:
            items = materialize(items, "items")
        found = frontier.triage(frontier.edges(parsed, "url", F.concat("links", "images")), scope)
        fresh = found.select("url", F.lit("pending").alias("status"), F.col("kind").alias("type"), F.lit(0).alias("retries")).distinct()
        done = F.when(F.col("error").isNull(), "completed").when(F.col("error") == "robots", "skipped_robots").otherwise("failed")
        changes = judged.select("url", done.alias("status"), F.nullif("error", F.lit("robots")).alias("error"), at.alias("at"), F.lit(rounds).alias("seq"))
        failed = judged.filter("error IS NOT NULL AND error <> 'robots'").select("url")
        merged = state.add_retries(state.merge_status(store, changes), failed)
        older, before, store = before, store, materialize(state.insert_ignore(merged, fresh, F.col("type"))[0], "store")
        # This round's pages are not read again; the store of the round before is kept for who looks at it just now.
        release(judged)
        if older is not None:
            release(older)
    if assets is not None:
        at = F.lit(datetime.now(timezone.utc))
        held = assets.filter("content IS NOT NULL").select("url", F.lit(True).alias("held")).distinct()
        asked = state.pending(store, "asset", most_retries).select("url").join(held, "url", "left")
        done = F.when(F.col("held"), "completed").otherwise("failed")
        changes = asked.select("url", done.alias("status"), F.when(~F.coalesce("held", F.lit(False)), "HTTP 404").alias("error"), at.alias("at"), F.lit(rounds + 1).alias("seq"))
        store = materialize(state.merge_status(store, changes), "store")
    if items is None:
        items = pages.sparkSession.createDataFrame([], "url string, title string, markdown string, engine string")
    return Mission(store, items, rounds)
