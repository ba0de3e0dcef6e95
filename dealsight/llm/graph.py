"""Connected components by alternating star contractions, and pairs of zones dealt into tiles; edges never leave the cluster."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).  Nodes without an edge are not listed.

    The large star hangs each node's larger neighbours on its smallest neighbour, the small star does so with the others;
    both keep components whole, and after about log rounds every node hangs on its smallest one.  A node's neighbours are
    only reduced to a minimum and joined back, so one with very many is no group in one task.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, known = None, e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = known, cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(old)
        known = e
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tiles(met: DataFrame, chunk: int, chunk_size: int) -> DataFrame:
    """(z1, z2, i, j, side, rep) from the members (z1, z2, side, rep, n) of zone pairs.

    A side is dealt into chunks of about ``chunk`` members whose ``n`` sum to about ``chunk_size``; every two chunks that
    meet are a tile.  A zone that meets itself has one side; its tiles with i = j hold all pairs, others those across sides.
    """
    met = cut(met)
    size = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / chunk_size)).cast("int")
    parts = met.groupBy("z1", "z2").pivot("side", [0, 1]).agg(size.alias("p"), F.count(F.lit(1)).alias("m"))
    parts = parts.select("z1", "z2", *[F.coalesce(f"{s}_{c}", F.lit(0)).alias(o) for s, c, o in ((0, "p", "a"), (1, "p", "b"), (0, "m", "na"), (1, "m", "nb"))])
    same = F.col("z1") == F.col("z2")
    parts = parts.where(F.when(same, F.col("na") > 1).otherwise((F.col("na") > 0) & (F.col("nb") > 0)))
    rows = met.join(parts, ["z1", "z2"])
    rows = rows.withColumn("k", F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(same | (F.col("side") == 1), F.col("a")).otherwise(F.col("b")) - 1)))
    i = F.when(same, F.least("k", "o")).when(F.col("side") == 0, F.col("k")).otherwise(F.col("o"))
    j = F.when(same, F.greatest("k", "o")).when(F.col("side") == 0, F.col("o")).otherwise(F.col("k"))
    side = F.when(same, (F.col("k") > F.col("o")).cast("int")).otherwise(F.col("side"))
    return rows.select("z1", "z2", i.alias("i"), j.alias("j"), side.alias("side"), "rep")
