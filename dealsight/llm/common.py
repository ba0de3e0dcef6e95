"""Helpers shared by the corpus operators."""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dealsight.functions.scale import cut, release  # noqa: F401  (re-exported for the operators)

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts at exactly these six white-space characters


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow``; when a task ends, its worker, which lives on, gives the memory back that it no longer uses."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return df.mapInArrow(task, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; ``fn`` may return None for no rows.  Column names may hold any character."""
    names = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(names))]) if any(set(c) & {".", "`"} for c in names) else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b.rename_columns(names))
                if out is not None and out.num_rows:
                    yield out

    return in_arrow(plain, run, schema)


def sample_ids(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` ids, the smallest by a seeded hash: the same rows on every run, at most ``n`` rows leave a task."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: set[tuple] = set()
        for b in batches:
            kept.update(zip(b.column("_h").to_pylist(), b.column(key).to_pylist()))
            if len(kept) > 4 * n:
                kept = set(heapq.nsmallest(n, kept))
        if kept:
            hashes, ids = zip(*heapq.nsmallest(n, kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(key).type), pa.array(hashes)], [key, "_h"])

    rows = df.where(F.col(key).isNotNull()).select(key, F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))).alias("_h"))
    few = in_arrow(rows, smallest, T.StructType([rows.schema[key], T.StructField("_h", T.StringType())]))
    return few.distinct().orderBy("_h", key).limit(n).select(key)


MOST_BITS = 1 << 26  # 8 MB in every task


def bit_of(c: str | Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits))


def bit_table(ids: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """A table with the bits of all ids set, sized by their number up to ``MOST_BITS``; a clear bit rules an id out."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (8 * ids.count()).bit_length()))
    marks = ids.select(bit_of(column, bits).alias("_b")).groupBy(F.expr("_b div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b % 32 as int))")).alias("m")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[marks.column("w").to_numpy()] = marks.column("m").to_numpy().astype(np.uint32)
    return bits, table


def bits_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)
