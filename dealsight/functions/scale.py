"""Ordered work that does not put a whole key, or the whole table, in one task.

A key may hold a third of all rows, so nothing here sorts one key's rows in a
single task: top-k prunes before the shuffle, ranks use range slices with
offsets, lags and running values work inside (key, bucket) and carry one row
per bucket across the boundary; range slices serve as buckets where a key may
be busy at one time.
"""
from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="dealsight-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable shared storage and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(df: DataFrame) -> None:
    """Delete the files of a DataFrame from ``cut`` that nothing reads any more: what is still needed must be cut itself."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the columns of ``left``, then the other columns of ``right``."""
    side = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(side[f"_k_{k}"]) for k in keys])
    return left.join(side, on, how).drop(*[f"_k_{k}" for k in keys])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by partial aggregation (hot keys combine map-side)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """k best rows per key; Spark's window group limit keeps k per key per input
    partition before the shuffle, so a hot key moves k x partitions rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "position",
              total: str | None = None, slices: int | None = None) -> DataFrame:
    """1-based position inside each ``by`` group (or overall) in ``order``.

    Rows are range-partitioned on (by, order) so a big group spans many slices;
    each slice ranks its own rows and adds the row count of earlier slices.
    ``order`` must be a total order.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    groups = [F.col(b) for b in by]
    spread = cut(df.repartitionByRange(n, *groups, *order).withColumn("_slice", F.spark_partition_id()))
    counts = spread.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = counts.select(*by, "_slice",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(whole).alias("_total"))
    if not by:
        offsets = F.broadcast(offsets)  # one row per slice
    joined = join_on(spread, offsets, [*by, "_slice"])
    local = F.row_number().over(W.partitionBy(*by, "_slice").orderBy(*order))
    res = joined.withColumn(out, (local + F.col("_before")).cast("bigint"))
    if total:
        res = res.withColumn(total, F.col("_total").cast("bigint"))
    return res.drop("_slice", "_before", "_total")


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_slice``: the range slice of a row in (keys, order), as many as there are shuffle partitions.

    Slices hold about equally many rows however a key's rows are spread over time, so a bucket ``F.col("_slice")`` for the
    running values below keeps no key, and no busy hour of one, in one task.  ``order`` should tell all rows of a key apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))


def previous_values(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                    values: dict[str, str]) -> DataFrame:
    """Add ``out = value of the previous row`` for each ``values[out] = col``.

    ``lag`` runs inside (key, bucket); the first row of a bucket takes the last
    row of the previous non-empty bucket, found on a one-row-per-bucket table.
    """
    b = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order)
    payload = F.struct(*[F.col(c).alias(o) for o, c in values.items()])
    ends = b.groupBy(*keys, "_bucket").agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    carried = ends.select(*keys, "_bucket",
                          F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    res = (b.withColumn("_first", F.row_number().over(inner) == 1)
           .withColumn("_in", F.lag(payload).over(inner)))
    res = join_on(res, carried, [*keys, "_bucket"], "left")
    for o in values:
        res = res.withColumn(o, F.when(F.col("_first"), F.col(f"_carry.{o}")).otherwise(F.col(f"_in.{o}")))
    return res.drop("_bucket", "_first", "_in", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence[str],
                value: Column, out: str) -> DataFrame:
    """Inclusive running sum per key, split at buckets of the order column.

    Without a bucket the rows are cut into range slices of (keys, order), as many as there are shuffle partitions, so
    that no slice grows with one key; ``order`` must then be total.
    """
    if bucket is None:
        b = sliced(df.withColumn("_v", value), keys, order).withColumnRenamed("_slice", "_bucket")
    else:
        b = df.withColumn("_bucket", bucket).withColumn("_v", value)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = b.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offs = sums.select(*keys, "_bucket", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    return (join_on(b.withColumn("_within", F.sum("_v").over(inner)), offs, [*keys, "_bucket"])
            .withColumn(out, F.col("_within") + F.col("_off")).drop("_bucket", "_v", "_within", "_off"))


def running_max(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Per key, the largest value among strictly earlier rows, split at buckets of the order column."""
    b = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "_bucket").agg(*[F.max(c).alias(f"_t_{o}") for o, c in values.items()])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*keys, "_bucket", *[F.max(f"_t_{o}").over(before).alias(f"_b_{o}") for o in values])
    for o, c in values.items():
        b = b.withColumn(f"_w_{o}", F.max(c).over(inner))
    b = join_on(b, tops, [*keys, "_bucket"])
    for o in values:
        b = b.withColumn(o, F.greatest(f"_w_{o}", f"_b_{o}"))
    return b.drop("_bucket", *[f"_w_{o}" for o in values], *[f"_b_{o}" for o in values])


def count_before(df: DataFrame, keys: Sequence[str], ts: str, tie: str, shift: Column, pos: str, out: str) -> DataFrame:
    """Per row: its position ``pos`` in (ts, tie) order and ``out`` = rows of its key with ts < ts + shift.

    Each row sends a zero-valued probe at ts + shift through one running sum.
    """
    e = df.select(*keys, F.col(tie).alias("_id"), F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(1).alias("_w"))
    p = df.select(*keys, F.col(tie).alias("_id"), (F.col(ts) + shift).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).alias("_w"))
    run = running_sum(e.unionByName(p), keys, None, ["_t", "_kind", "_id"], F.col("_w"), "_cum")
    return run.groupBy(*keys, F.col("_id").alias(tie)).agg(F.max(F.when(F.col("_kind") == 1, F.col("_cum"))).alias(pos),
                                                           F.max(F.when(F.col("_kind") == 0, F.col("_cum"))).alias(out))


def reachable(jumps: DataFrame, keys: Sequence[str], start: int, pos: str = "pos", nxt: str = "next") -> DataFrame:
    """Positions visited from ``start`` by following ``nxt`` in every key, by pointer doubling.

    After k rounds the first 2^k stops are known, so a chain of n stops takes log2(n)
    rounds, each an equi join on (key, position).
    """
    hop = cut(jumps.select(*keys, F.col(pos).alias("_p"), F.col(nxt).alias("_q")))
    seen = hop.filter(F.col("_p") == start).select(*keys, "_p")
    while True:
        more = cut(seen.unionByName(seen.join(hop, [*keys, "_p"]).select(*keys, F.col("_q").alias("_p"))).distinct())
        far = hop.select(*keys, F.col("_p").alias("_q"), F.col("_q").alias("_z"))
        hop = cut(hop.join(far, [*keys, "_q"]).select(*keys, "_p", F.col("_z").alias("_q")))
        if hop.isEmpty():
            return more.withColumnRenamed("_p", pos)
        seen = more


SKETCH = 10_000  # a sketched rank is off by at most 1 / SKETCH of a group
MARGIN = 10 / SKETCH  # how far around a position its bracket reaches
WHOLE_GROUP = 50_000  # groups up to this size keep all their distinct values


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, tie: str, ps: dict[str, float],
                    exclusive: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group: a sketch brackets each position, one pass selects inside the brackets.

    Inclusive puts p at position 1 + p(n-1).  The names in ``exclusive`` put it at
    p(n+1) with the lower position held to [1, n-1] and the remainder left unclamped.

    Both passes combine on the map side: the sketch is mergeable, and what leaves a task in the second pass is one count
    of the rows below each bracket and the counts of equal values inside it.  No rows are sorted, whatever a group's size.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = [x for q in ps.values() for x in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", ends, SKETCH).alias("_e"))
    end = lambda k: F.when(F.col("n") <= WHOLE_GROUP, F.lit(float("-inf") if k % 2 == 0 else float("inf"))).otherwise(F.col("_e")[k])
    sketch = cut(sketch.select(*by, "n", *[end(k).alias(f"_e{k}") for k in range(len(ends))]))
    at = []
    for i in range(len(ps)):  # a value below its bracket counts under the null value
        low, high = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
        at.append(F.when(F.col("_v") <= high, F.struct(F.lit(i).alias("_i"), F.when(F.col("_v") >= low, F.col("_v")).alias("_v"))))
    inside = (join_on(rows, sketch, by) if by else rows.crossJoin(F.broadcast(sketch)))  # without groups the sketch is one row
    inside = inside.select(*by, "n", F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias("_x"))
    counts = inside.groupBy(*by, "n", F.col("_x._i").alias("_i"), F.col("_x._v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = W.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_c", F.sum("_c").over(run))
    aggs, outs = [], []
    for i, (name, q) in enumerate(ps.items()):
        h = F.lit(q) * (F.col("n") + 1) if name in exclusive else F.lit(q) * (F.col("n") - 1) + 1
        lo = F.greatest(F.least(F.floor(F.round(h, 9)), F.greatest(F.col("n") - 1, F.lit(1))), F.lit(1))
        mine = (F.col("_i") == i) & F.col("_v").isNotNull()
        aggs += [F.min(F.when(mine & (F.col("_c") >= lo), F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(mine & (F.col("_c") >= lo + 1), F.col("_v"))).alias(f"_hi_{name}"),
                 F.max(F.when((F.col("_i") == i) & F.col("_v").isNull(), F.col("_c") >= lo)).alias(f"_under_{name}"),
                 F.max(lo < F.col("n")).alias(f"_more_{name}"), F.max(F.round(h, 9) - lo).alias(f"_f_{name}")]
        missed = F.coalesce(f"_under_{name}", F.lit(False)) | F.col(f"_lo_{name}").isNull() | (F.col(f"_more_{name}") & F.col(f"_hi_{name}").isNull())
        step = (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")
        never = F.raise_error(F.lit(f"the bracket of {name} missed its position")).cast("double")  # the sketch's error is a tenth of the margin
        outs.append(F.when(missed, never).otherwise(F.col(f"_lo_{name}") + F.coalesce(step, F.lit(0.0))).alias(name))
    return counts.groupBy(*by, "n").agg(*aggs).select(*by, "n", *outs)
