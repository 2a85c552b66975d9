"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from postlake.plans import flow_queries, page_queries, source_queries, store_queries  # noqa: F401  (register their queries)
from postlake.plans.queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
