"""The registered queries and their SQL."""

from __future__ import annotations

from siltstream.plans import crawl_queries, engine_queries, page_queries, policy_queries, report_queries, sample_pages, state_queries, text_queries  # noqa: F401
from siltstream.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
