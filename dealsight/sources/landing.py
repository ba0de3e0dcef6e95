"""Landing zone, run ledger and exports."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dealsight.functions.clock import at, micros_between
from dealsight.functions.scale import checkpoint_folder, join_on


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder the session names."""
    base = checkpoint_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def raw_landing(df: DataFrame, path: str, source: Column, ts: Column) -> None:
    """Append raw rows partitioned by source and date.

    Rows are rebalanced by (source, day): small partitions are joined and a hot (source, day) is split by its measured size,
    into as many files as it needs.
    """
    d = df.withColumn("source", source).withColumn("dt", ts.cast("date"))
    d.hint("rebalance", "source", "dt").write.mode("append").partitionBy("source", "dt").parquet(path)


def retained(landed: DataFrame, as_of, years: int = 7) -> DataFrame:
    """Rows inside the retention window; whole partitions are pruned."""
    return landed.filter(F.col("dt") >= F.add_months(at(as_of).cast("date"), -12 * years))


def expired_partitions(landed: DataFrame, as_of, years: int = 7) -> DataFrame:
    return landed.filter(F.col("dt") < F.add_months(at(as_of).cast("date"), -12 * years)).select("source", "dt").distinct()


def export_watchlist(entries: DataFrame, path: str, fmt: str, statistics: DataFrame | None = None) -> None:
    """JSON, with the list's statistics beside it if given, or CSV; anything else is an error."""
    if fmt == "json":
        entries.write.mode("overwrite").json(path)
        if statistics is not None:
            statistics.write.mode("overwrite").json(f"{path.rstrip('/')}-statistics")
    elif fmt == "csv":
        entries.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def split_bad(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantine; a bad record never fails the run."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)


def ingestion_ledger(records: DataFrame, ok: Column, by: list[str], ts: str, runs: DataFrame | None = None, published: Column | None = None) -> DataFrame:
    """Fetched, transformed, published, status and duration per run.

    ``runs`` lists every run that was started (``by``, error): one with an error failed, one without records was skipped.
    Without it only runs that left records are known.  ``published`` marks the transformed records whose event went out.
    """
    g = records.groupBy(*by).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(ok).alias("transformed"),
                                 F.count_if(ok & (F.lit(True) if published is None else published)).alias("published"),
                                 F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    if runs is None:
        g = g.withColumn("error", F.lit(None).cast("string"))
    else:
        g = join_on(runs.select(*by, "error"), g, by, "left")
        g = g.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fetched", "transformed", "published")})
    status = (F.when(F.col("error").isNotNull(), "failed").when(F.col("fetched") == 0, "skipped")
              .when(F.col("transformed") > 0, "success").otherwise("partial"))
    return g.withColumn("status", status).withColumn("duration_seconds", F.floor(micros_between(F.col("start_time"), F.col("end_time")) / 1_000_000))


def ingestion_stats(ledger: DataFrame) -> DataFrame:
    """Totals per source."""
    return ledger.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
                                        F.count_if(F.col("status") == "failed").alias("failed"), F.sum("fetched").alias("fetched"),
                                        F.sum("transformed").alias("transformed"), F.sum("published").alias("published"))


def recent_errors(ledger: DataFrame, last: int = 10) -> DataFrame:
    """The newest failed runs over all sources."""
    return ledger.filter(F.col("error").isNotNull()).orderBy(F.col("start_time").desc(), "source").limit(last)
