"""All queries of this subpackage and their DuckDB counterparts, by name."""

from __future__ import annotations

from tidemark.llm import queries, sql

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op") and name[2].isdigit()}
ORACLES = {name: getattr(sql, name).strip() for name in dir(sql) if name in QUERIES}
