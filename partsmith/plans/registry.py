"""All catalogue queries: name -> query, name -> SQL."""

from __future__ import annotations

from . import catalog_queries, extract_queries, quality_queries, search_queries

MODULES = (search_queries, catalog_queries, extract_queries, quality_queries)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
