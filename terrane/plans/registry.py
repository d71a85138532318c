"""Registry of queries: a name, the operators it answers, its function and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.sources.adapters import SQL as PARTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def with_parts(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL that starts with the named adapter tables (and what they need), then ``extra``, then the body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for needed in PARTS[name][0]:
                add(needed)
            done[name] = PARTS[name][1]

    for name in names.split():
        add(name)
    parts = [f"{k} as ({v})" for k, v in (done | (extra or {})).items()]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body


def query(covers: str, parts: str = "", sql: str | None = None, extra: dict[str, str] | None = None, name: str | None = None):
    """Registers a function of (spark, folder) as the query that answers the operators ``covers`` names."""

    def keep(function):
        key = name or function.__name__
        assert key not in QUERIES, key
        QUERIES[key] = function
        COVERS[key] = tuple(covers.split())
        if sql is not None:
            ORACLES[key] = with_parts(parts, sql, extra)
        return function

    return keep
