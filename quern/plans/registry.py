"""Every query of the engine with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "hybrid_search"


def modules() -> list:
    from quern.plans import analytics_queries, bank_queries, corpus_queries, markup_queries, search_queries, text_queries

    return [search_queries, text_queries, analytics_queries, corpus_queries, bank_queries, markup_queries]


def queries() -> dict[str, Callable]:
    return {k: q for m in modules() for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in modules() for k, (_, sql) in m.QUERIES.items() if sql}
