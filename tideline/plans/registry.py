"""Name of a query -> how to run it, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
MODULES = ["sources", "filters", "joins", "aggregates", "sequences", "signals", "matrices", "reachability", "metrics", "contrasts", "scalars"]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tideline.plans.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)


def flagship(spark, sf_dir):
    _load()
    return QUERIES["t1_paired_contrast"](spark, sf_dir)
