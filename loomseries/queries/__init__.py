"""All registered queries and their comparison SQL."""

from . import (
    candle_queries,
    file_queries,
    graph_queries,
    indicator_queries,
    numeric_queries,
    record_queries,
    stream_queries,
)

MODULES = [indicator_queries, candle_queries, record_queries, numeric_queries, graph_queries, stream_queries, file_queries]


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.queries().items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
