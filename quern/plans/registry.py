"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from quern.plans import facets, filters, graphs, joins, logs, search  # noqa: F401  each registers its queries
from quern.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
