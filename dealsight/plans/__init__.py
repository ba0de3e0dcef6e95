"""Runnable queries over the test tables, one module per subject."""
from dealsight.plans.catalog import CATALOG, Query, query  # noqa: F401

import importlib as _il

for _m in ("scoring", "relational", "targeting", "deals", "market", "valuing", "backtest", "ingest", "specrules"):
    _il.import_module(f"dealsight.plans.{_m}")
