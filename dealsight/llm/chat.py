"""Cumulative-snapshot collapse of logged conversations, and their rendering; DataFrame functions only.

A log often holds every stage of a growing conversation.  Each turn gets a 128-bit hash of its place, role and text; the
running sums of these hashes along a conversation are its prefix hashes.  A conversation is dropped if its whole hash is
the hash of a proper prefix of another one, or if it equals one with a smaller ``conv_id``; two anti-joins do this on one
row per distinct prefix.  Turns are ranked and summed in blocks, so a conversation with a third of all turns is spread out.

Defined cases: turns are ordered by ``turn`` (null last), role and text, and repeated turns count each; a null ``conv_id``
is one conversation, the last in order; null roles and texts differ from empty ones in the hash and are rendered as
``unknown`` and as nothing; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.scale import positions
from dealsight.llm.common import cut

BLOCK = 1024  # turns whose hashes one window sums
PARTS = ("_h0", "_h1", "_h2", "_h3")


def _hash_parts() -> list[Column]:
    seen = [F.col("_pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    both = [F.xxhash64(F.lit(salt), *seen) for salt in ("turn", "again")]
    return [c for h in both for c in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def rendered() -> Column:
    """One turn in the usual markup; the marks themselves are broken up where a text contains them."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), clean, F.lit("<|im_end|>\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with place ``_pos`` of ``_n``, the prefix hash up to the turn, and ``_start``: characters rendered before it."""
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    rows = positions(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], order, "_pos", "_n")
    for name, part in zip(PARTS, _hash_parts()):
        rows = rows.withColumn(name, part)
    rows = rows.withColumn("_rendered", rendered()).withColumn("_start", F.length("_rendered").cast("long"))
    rows = rows.withColumn("_block", F.floor((F.col("_pos") - 1) / BLOCK))
    summed = (*PARTS, "_start")
    blocks = rows.groupBy("conv_id", "_block").agg(*[F.sum(c).alias(c) for c in summed])
    before = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"),
                           *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c}") for c in summed])
    inner = W.partitionBy("conv_id", "_block").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    for c in summed:
        rows = rows.withColumn(c, F.sum(c).over(inner) - (F.col(c) if c == "_start" else F.lit(0)))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    for c in summed:
        rows = rows.withColumn(c, F.col(c) + F.col(f"_o{c}"))
    return rows.select("conv_id", "role", "_pos", "_n", "_rendered", "_start", *PARTS)


def collapse(known: DataFrame) -> DataFrame:
    """Per conversation: ``n_turns``, ``kept``, and ``kept_in``: the longest conversation that begins with it, the
    smallest id among equals.  A kept conversation is kept in itself.  ``known`` comes from ``prefixes``."""
    ends = known.where(F.col("_pos") == F.col("_n")).select("conv_id", "_n", *PARTS)
    place = F.struct(F.col("conv_id").isNull(), "conv_id")
    first = F.min(place)["conv_id"]
    unique = ends.groupBy("_n", *PARTS).agg(first.alias("_rep"))
    longest = F.min(F.struct((-F.col("_n")).alias("n"), F.col("conv_id").isNull().alias("last"), F.col("conv_id").alias("id")))
    proper = known.where(F.col("_pos") < F.col("_n")).groupBy(F.col("_pos").alias("_n"), *PARTS).agg(longest["id"].alias("_in"), F.lit(True).alias("_longer"))
    unique = unique.join(proper, ["_n", *PARTS], "left")
    rows = ends.join(unique, ["_n", *PARTS])
    kept_in = F.when(F.col("_longer"), F.col("_in")).otherwise(F.col("_rep"))
    kept = F.col("_longer").isNull() & F.col("conv_id").eqNullSafe(F.col("_rep"))
    return rows.select("conv_id", F.col("_n").alias("n_turns"), kept.alias("kept"), kept_in.alias("kept_in"))


def render(turns: DataFrame) -> DataFrame:
    """The turns of the maximal conversations, rendered, with the offset of each in its conversation."""
    known = cut(prefixes(turns))
    found = cut(collapse(known))
    held = found.where(~F.col("kept")).groupBy(F.col("kept_in").alias("_k")).agg(F.count(F.lit(1)).alias("collapsed"))
    live = found.where("kept").join(held, F.col("conv_id").eqNullSafe(F.col("_k")), "left").select(
        F.col("conv_id").alias("_id"), F.coalesce("collapsed", F.lit(0)).alias("collapsed"))
    rows = known.join(live, F.col("conv_id").eqNullSafe(F.col("_id")))
    return rows.select("conv_id", F.col("_pos").alias("turn_no"), F.col("_n").alias("n_turns"), "role",
                       F.col("_rendered").alias("rendered"), F.col("_start").alias("start"), "collapsed")
