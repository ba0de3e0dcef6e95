"""Mixing sources to target weights by capped water-filling.

Every source asks for ``share`` of all words in proportion to its weight.  A target above ``limit`` times the source's
size is clamped there and the excess goes to the other sources by weight, again and again until none is above.  A
source's target is then taken as whole repetitions of all its documents plus one fractional repetition: its documents in
a seeded order up to the words still missing, the last one in part, so the words taken meet the target to within a word.

The order is a hash of the seed and ``doc_id``, then size and a hash of the text.  Its leading digits cut a source into
4,096 slices whose sizes are summed first; only the keys of the one slice in which the target falls are ordered, in range
slices, so a source with a third of all rows never meets in one task.  The outcome is one key a source, where its fractional
repetition ends; a row's words follow from comparing its own key with that one, so no text moves.

Defined cases: a null source is a source of its own, last in order; a null or text without words has size 0 and is taken
0 times; an empty table gives no rows; repeated rows are documents of their own, and equal rows at the end of a fractional
repetition share what is left to take evenly.
"""
from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.scale import positions, running_sum
from dealsight.llm.common import WORD, cut, map_batches, texts

DIGITS = 3  # hexadecimal digits of a slice
FEW_SOURCES = 10_000  # rows up to which the sources' plan is broadcast; beyond, the join shuffles and splits skew


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """Add ``target`` to rows of (size, weight); only four sums a round reach the driver.

    Each round clamps the sources whose share is at or over their limit; the level rises, so a clamped source stays
    clamped and the rounds end when no further one joins them.
    """
    cap = F.lit(limit) * F.col("_size")
    total, weight = sources.agg(F.sum("_size"), F.sum("_weight")).first()
    if not total:
        return sources.withColumn("_target", F.lit(0.0))
    level, clamped = share * total / weight, -1
    while True:
        over = cap <= F.lit(level) * F.col("_weight")
        n, held, rest = sources.agg(F.sum(F.when(over, 1).otherwise(0)), F.sum(F.when(over, cap).otherwise(0.0)),
                                    F.sum(F.when(over, 0).otherwise(F.col("_weight")))).first()
        if n == clamped or not rest:
            return sources.withColumn("_target", F.when(over, cap).otherwise(F.lit(level) * F.col("_weight")))
        level, clamped = (share * total - held) / rest, n


def plan(docs: DataFrame, weights: Sequence[float], share: float, limit: float, seed: str) -> DataFrame:
    """One row per source: size, target, whole repetitions, and where its fractional repetition ends."""
    slices = cut(docs.select(F.col("source").alias("_source"), words("text").alias("_n"), _slice(seed).alias("_slice"))
                 .groupBy("_source", "_slice").agg(F.sum("_n").alias("_n")))
    sources = slices.groupBy("_source").agg(F.sum("_n").alias("_size"))
    sources = positions(sources, [], [F.col("_source").asc_nulls_last()], "_place")
    sources = cut(sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))))
    filled = water_fill(sources, share, limit)
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("_whole", whole).withColumn("_part", F.floor(F.col("_target") - F.col("_whole") * F.col("_size")).cast("long"))
    before = F.sum("_n").over(W.partitionBy("_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    ends = (slices.withColumn("_before", before).withColumnRenamed("_source", "_s")
            .join(filled.select(F.col("_source").alias("_s2"), "_part"), F.col("_s").eqNullSafe(F.col("_s2")))
            .where((F.col("_before") <= F.col("_part")) & (F.col("_part") < F.col("_before") + F.col("_n")))
            .select("_s", F.col("_slice").alias("_end"), "_before", "_part"))
    keys = docs.select(F.col("source").alias("_source"), words("text").alias("_size"), _order(seed).alias("_order"), F.md5("text").alias("_hash"))
    ends = cut(ends)
    at = F.col("_source").eqNullSafe(F.col("_s")) & (F.substring("_order", 1, DIGITS) == F.col("_end"))
    keys = keys.where("_size > 0").join(_near(ends), at).groupBy("_source", "_order", "_size", "_hash", "_before", "_part").agg(F.count(F.lit(1)).alias("_c"))
    keys = running_sum(keys, ["_source"], None, ["_order", "_size", "_hash"], F.col("_c") * F.col("_size"), "_sum")
    left = F.col("_part") - F.col("_before") - F.col("_sum") + F.col("_c") * F.col("_size")
    last = keys.withColumn("_left", left).where((F.col("_left") >= 0) & (F.col("_left") < F.col("_c") * F.col("_size")))
    last = last.select(F.col("_source").alias("_s"), F.struct("_order", "_size", "_hash").alias("_end"), F.floor(F.col("_left") / F.col("_c")).alias("_each"))
    return cut(filled.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s", "_place"))


def _near(sources: DataFrame) -> DataFrame:
    """Rows by source, broadcast if they are a checked, small number: then texts are not shuffled to meet them."""
    return F.broadcast(sources) if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else sources


def _order(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _slice(seed: str) -> Column:
    return F.substring(_order(seed), 1, DIGITS)


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0,
        seed: str = "mix") -> DataFrame:
    """``row`` (the document), its ``size``, ``source_size`` and ``target`` of its source, ``taken``: words the mix takes."""
    goals = plan(docs, weights, share, limit, seed).withColumnRenamed("_size", "_source_size")
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), "source", words("text").alias("size"),
                       _order(seed).alias("_order"), F.md5("text").alias("_hash"))
    rows = rows.join(_near(goals), F.col("source").eqNullSafe(F.col("_source")))
    key = F.struct("_order", F.col("size").alias("_size"), "_hash")
    extra = F.when((F.col("size") == 0) | F.col("_end").isNull() | (key > F.col("_end")), 0).when(key < F.col("_end"), F.col("size")).otherwise(F.col("_each"))
    taken = (F.col("_whole") * F.col("size") + extra).cast("long")
    return rows.select("row", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def whole_documents(mixed: DataFrame) -> DataFrame:
    """The mix with the document at the end of each fractional repetition taken whole or not at all, whichever is nearer."""
    some = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0))
    return mixed.withColumn("taken", (some * F.col("size")).cast("long"))


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    at = 0
    for w in text.split(None, n)[:n]:
        at = text.index(w, at) + len(w)
    return text[:at]


def materialise(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: whole copies, and of a document taken in part its first words."""
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    some = mixed.where(F.col("taken") > 0)
    copies = some.where(full > 0).select("row", F.explode(F.sequence(F.lit(1), full)).alias("copy")).select("row.*")
    parts = some.select("row", (F.col("taken") % F.col("size")).alias("keep")).where("keep > 0")
    parts = parts.select(F.col("row.text").alias("text"), "row", "keep")
    text_type = mixed.schema["row"].dataType["text"].dataType

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [first_words(t, n).decode("utf-8", "replace") for t, n in zip(texts(b), b.column("keep").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(text, b.schema.field("text").type), b.column("row")], ["text", "row"])

    parts = map_batches(parts, batch, parts.select("text", "row").schema)
    row = F.col("row").withField("text", F.col("text").cast(text_type))
    if "n_chars" in copies.columns:
        row = row.withField("n_chars", F.length("text").cast(copies.schema["n_chars"].dataType))
    return copies.unionByName(parts.select(row.alias("row")).select("row.*"))
