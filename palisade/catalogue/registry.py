"""Registration of queries and assembly of their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.catalogue import standins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name any stand-in table (or one of ``ctes``) and is completed with their definitions."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = complete(sql, ctes or {})
        return fn

    return add


def complete(sql: str, extra: dict[str, str]) -> str:
    """Prefix ``WITH`` for every stand-in the statement uses, in definition order."""
    bodies = {**standins.sql_bodies(), **{k: standins.duck(v) for k, v in extra.items()}}
    sql = standins.duck(sql)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for n in bodies:
            if n not in needed and re.search(rf"\b{n}\b", text):
                needed.add(n)
                visit(bodies[n])

    visit(sql)
    ctes = [f"{n} AS ({bodies[n]})" for n in bodies if n in needed]
    sql = sql.strip()
    if ctes and sql[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {sql[5:]}"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + sql
