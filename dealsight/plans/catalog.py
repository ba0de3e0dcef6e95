"""Registry of runnable queries: name -> (function of Tables, check SQL)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.adapters.tpch import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    item: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(item: str, name: str, sql: str | None = None):
    """Register a query for survey item ``item``; ``sql`` is its check query."""

    def register(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, item, fn, with_views(sql) if sql else None)
        return fn

    return register


def r(c: str | Column, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits)
    return out.alias(c) if isinstance(c, str) else out


def n(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def s(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def join_list(c: str, alias: str | None = None) -> Column:
    return F.array_join(F.col(c), "|").alias(alias or c)
