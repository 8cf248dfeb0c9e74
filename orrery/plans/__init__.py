"""The library's named queries and, where SQL can tell them, their DuckDB twins."""

from __future__ import annotations


def catalogue() -> tuple[dict, dict]:
    from . import relational, series, stats, streams, topology

    queries: dict = {}
    oracles: dict = {}
    for part in (series, relational, streams, stats, topology):
        queries |= part.QUERIES
        oracles |= part.ORACLES
    return queries, oracles
