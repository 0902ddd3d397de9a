"""All registered queries, in one place."""

from __future__ import annotations

from quantloom.plans import (
    data_queries,
    fundamental_queries,
    option_queries,
    pair_queries,
    report_queries,
    series_queries,
)
from quantloom.plans.common import Query

MODULES = (series_queries, pair_queries, option_queries, fundamental_queries, data_queries, report_queries)


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, fn in m.CAT.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.CAT.oracles.items()}
