"""All engine queries with their DuckDB SQL. The package imports the plan modules, and each registers its own."""

from __future__ import annotations

FLAGSHIP = "slice_translation_eval"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
