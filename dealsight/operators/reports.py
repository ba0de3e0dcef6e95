"""Report-side rollups: success rates, heat map, run summaries, price rollup."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def trial_success_rate(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Completed / (completed + terminated) at every rollup level."""
    done, stopped = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "terminated")
    return trials.rollup(*by).agg(done.alias("completed"), F.try_divide(done, done + stopped).alias("success_rate"))


def price_daily_rollup(ticks: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",), tie: str = "tick_id") -> DataFrame:
    """Open, high, low, close, volume and mean price per key and day."""
    order = F.struct(ts, tie)
    return ticks.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.avg("price").alias("vwap"))


def sector_heatmap(pairs: DataFrame, row: str, col: str, values: Sequence[str], value: Column) -> DataFrame:
    """Row x column heat map over a known list of columns."""
    return pairs.groupBy(row).pivot(col, list(values)).agg(value).na.fill(0)


def sector_cube(rows: DataFrame, dims: Sequence[str], value: Column) -> DataFrame:
    """Every grouping level of the sector analysis."""
    return rows.cube(*dims).agg(F.count(F.lit(1)).alias("n"), value.alias("value"))


def run_summary(scores: DataFrame, matches: DataFrame, change_over: float = 10.0) -> DataFrame:
    """One ledger row: companies scored, significant changes, mean and best score, match counts."""
    s = scores.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.abs("change") > change_over).alias("significant"),
                   F.avg("score").alias("avg_score"), F.max("score").alias("max_score")).withColumn("_one", F.lit(1))
    m = matches.agg(F.count_distinct("company_id").alias("targets"), F.count(F.lit(1)).alias("matches")).withColumn("_one", F.lit(1))
    return s.join(F.broadcast(m), "_one").drop("_one").withColumn("matches_per_target", F.coalesce(F.try_divide("matches", "targets"), F.lit(0.0)))
