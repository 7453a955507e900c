"""The registered queries of the lake and their SQL."""

from __future__ import annotations

from loamlake.plans import driver_queries, lake_queries, source_queries

_MODULES = (driver_queries, lake_queries, source_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
