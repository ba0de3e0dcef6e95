"""Band ladders and lookups as Columns.

A band table is a list of ``(bound, value)`` pairs; the first pair that matches
wins and ``default`` covers the rest (NULL input included).  Tables are plain
data, so callers replace them to change a rule set.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

Steps = Sequence[tuple[float, float]]


def _value(v):
    return v if isinstance(v, Column) else F.lit(v)


def _ladder(pairs, default) -> Column:
    out = None
    for cond, value in pairs:
        out = F.when(cond, _value(value)) if out is None else out.when(cond, _value(value))
    return _value(default) if out is None else out.otherwise(_value(default))


def below(x: Column, steps: Steps, default) -> Column:
    """value of the first step with ``x < bound`` (steps ascending)."""
    return _ladder([(x < b, v) for b, v in steps], default)


def at_most(x: Column, steps: Steps, default) -> Column:
    return _ladder([(x <= b, v) for b, v in steps], default)


def above(x: Column, steps: Steps, default) -> Column:
    """value of the first step with ``x > bound`` (steps descending)."""
    return _ladder([(x > b, v) for b, v in steps], default)


def at_least(x: Column, steps: Steps, default) -> Column:
    return _ladder([(x >= b, v) for b, v in steps], default)


def first_match(pairs: Sequence[tuple[Column, object]], default) -> Column:
    return _ladder(pairs, default)


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Dimension lookup for small fixed dimensions; stays inside codegen."""
    return _ladder([(key == k, v) for k, v in table.items()], F.lit(default))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def points(flag: Column, value) -> Column:
    """``value`` where flag is true, 0 where false or NULL."""
    return F.when(flag, _value(value)).otherwise(F.lit(0))


def truthy(x: Column) -> Column:
    """0 and NULL both count as missing."""
    return F.coalesce(x, F.lit(0)) != 0



# --- the same tables as SQL text, for checks in another engine ---------------

def _sql(pairs, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def sql_below(x: str, steps: Steps, default) -> str:
    return _sql([(f"{x} < {b}", v) for b, v in steps], default)


def sql_at_most(x: str, steps: Steps, default) -> str:
    return _sql([(f"{x} <= {b}", v) for b, v in steps], default)


def sql_above(x: str, steps: Steps, default) -> str:
    return _sql([(f"{x} > {b}", v) for b, v in steps], default)


def sql_at_least(x: str, steps: Steps, default) -> str:
    return _sql([(f"{x} >= {b}", v) for b, v in steps], default)


def sql_lookup(x: str, table: Mapping, default) -> str:
    q = lambda k: f"'{k}'" if isinstance(k, str) else k
    return _sql([(f"{x} = {q(k)}", q(v)) for k, v in table.items()], q(default))


def tidy(x: Column, digits: int = 2) -> Column:
    """Round a score; float noise is dropped first so exact ties round up."""
    return F.round(F.round(x.cast("double"), 9), digits)


def sql_tidy(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"
