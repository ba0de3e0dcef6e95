"""Nearest neighbours by largest inner product: an inverted-list index scanned by adaptive dimension sampling.

A further component lifts every vector to one common length, where the largest inner product is the smallest distance.
Vectors are rotated at random, so the distance over the first d of D dimensions, scaled by D / d, estimates the whole.
A list is scanned in blocks of columns; after each block a candidate is abandoned if even the estimate's lower confidence
bound, estimate / (1 + margin / sqrt(d)) ** 2, lies beyond the query's k-th distance so far.  That distance comes from the
lists nearest to the query, which are scanned first.  Scores of what remains are computed on the original vectors.

Centroids are fitted on at most ``fit_rows`` rows; every row is indexed.  Lists are cut into blocks of bounded size and a
list's queries into chunks, so a hot list is many tasks.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
dimension than most; rows with the query's id are not its candidates; equal vectors tie and the smaller id comes first;
with fewer than k candidates all are returned; an empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsight.functions.scale import top_per_key
from dealsight.llm.common import cut, map_batches, sample_ids

COLUMNS = 16  # dimensions a column block adds
BLOCK, CHUNK = 4096, 1024  # most candidates and, about, queries that meet in one task step
VECTOR = "vec_id long, v array<double>"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(~odd).where(F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class Lists:
    """Rotation of the lifted space, rotated centroids, and the common length of lifted vectors."""

    rotation: np.ndarray
    centroids: np.ndarray
    length: float
    share: float = 1.0  # of the lists, how many a query visits

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows of the table, lifted and rotated."""
        rest = np.sqrt(np.maximum(self.length ** 2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], 1) @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] + (self.centroids ** 2).sum(1)[None] - 2 * x @ self.centroids.T


def visited(lists: Lists, plain: np.ndarray, lifted: np.ndarray, k: int, recall: float, tries: int = 256) -> float:
    """The share of lists that holds ``recall`` of the true neighbours, by brute force within the sample."""
    tries, home = min(tries, len(plain)), lists.distances(lifted).argmin(1)
    score = plain[:tries] @ plain.T
    score[np.arange(tries), np.arange(tries)] = -np.inf
    k = min(k, len(plain) - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(-score, k - 1, 1)[:, :k]
    order = np.argsort(lists.distances(lists.queries(plain[:tries])), 1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
    needed = rank[np.arange(tries)[:, None], home[near]] + 1
    return float(np.quantile(needed, recall, method="higher")) / order.shape[1]


def fit(rows: DataFrame, n: int, k: int, recall: float, fit_rows: int, max_lists: int, seed: int) -> Lists:
    """k-means on a bounded sample of rows; as many lists as the square root of the row count, up to ``max_lists``."""
    length = float(np.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]))
    pick = sample_ids(rows, "vec_id", fit_rows, f"lists{seed}")
    got = sorted((r[0], tuple(r[1])) for r in rows.join(F.broadcast(pick), "vec_id", "left_semi").collect())
    plain = np.array([v for _, v in got])[np.random.default_rng(seed).permutation(len(got))]
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(plain.shape[1] + 1,) * 2))[0]
    x = Lists(rotation, plain[:0], length).lifted(plain)
    count = int(min(max(1, round(np.sqrt(n))), max_lists, len(x)))
    lists = Lists(rotation, x[rng.choice(len(x), count, replace=False)], length)
    for _ in range(10):
        at = lists.distances(x).argmin(1)
        sums, held = np.zeros_like(lists.centroids), np.bincount(at, minlength=count)
        np.add.at(sums, at, x)
        lists = Lists(rotation, np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], lists.centroids), length)
    return Lists(rotation, lists.centroids, length, visited(lists, plain, x, k, recall))


def scan(q: np.ndarray, x: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the tests do not abandon.  ``own`` marks pairs to leave out; ``bound`` is each
    query's k-th squared distance so far, infinite where none is known yet: the first candidates then give one."""
    dims = q.shape[1]
    slack = 1e-9 * ((q ** 2).sum(1) + (x ** 2).sum(1).max(initial=0.0)) + 1e-300  # equal scores stay equal at any size of vectors
    if not np.isfinite(bound).all():
        seed = ((q[:, None, :] - x[None, :4 * k]) ** 2).sum(2) if len(q) * min(len(x), 4 * k) * dims < 5e7 else np.stack([((x[:4 * k] - r) ** 2).sum(1) for r in q])
        seed[own[:, :4 * k]] = np.inf
        if seed.shape[1] >= k:
            bound = np.minimum(bound, np.partition(seed, k - 1, 1)[:, k - 1] + slack)
    a, b, part = None, None, None
    for lo in range(0, dims, COLUMNS):
        hi = min(lo + COLUMNS, dims)
        if part is None:
            step = (q[:, lo:hi] ** 2).sum(1)[:, None] + (x[:, lo:hi] ** 2).sum(1)[None] - 2 * q[:, lo:hi] @ x[:, lo:hi].T
            step[own] = np.inf
            a, b = np.nonzero(step * (dims / hi) <= (bound * (1 + margin / np.sqrt(hi)) ** 2 + slack)[:, None] if hi < dims else step <= (bound + slack)[:, None])
            part = step[a, b]
        else:
            part = part + ((q[a, lo:hi] - x[b, lo:hi]) ** 2).sum(1)
            limit = bound[a] + slack[a] if hi == dims else bound[a] * (1 + margin / np.sqrt(hi)) ** 2 * (hi / dims) + slack[a]
            live = part <= limit
            a, b, part = a[live], b[live], part[live]
    live = np.isfinite(part)
    return a[live], b[live]


def best(query: np.ndarray, cand: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best: larger score, then smaller id."""
    order = np.lexsort((cand, -score, query))
    first = np.r_[True, query[order][1:] != query[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.97, fit_rows: int = 20_000,
           max_lists: int = 2048, margin: float = 2.1, seed: int = 5) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    A query visits its nearest lists: the share of them that held ``recall`` of the true neighbours within the sample,
    and as many as hold ``2 k`` rows at least.
    """
    out = "query_id long, vec_id long, score double"
    rows = valid(vectors)
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = fit(rows, n, k, recall, fit_rows, max_lists, seed)
    count = len(lists.centroids)

    def to_list(b: pa.RecordBatch) -> pa.RecordBatch:
        near = [lists.distances(lists.lifted(matrix(b.column("v").slice(s, CHUNK)))).argmin(1) for s in range(0, b.num_rows, CHUNK)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(near).astype(np.int32))], [*b.schema.names, "list"])

    indexed = cut(map_batches(rows, to_list, VECTOR + ", list int"))
    size = np.zeros(count, np.int64)
    for r in indexed.groupBy("list").count().collect():  # one row a list
        size[r[0]] = r[1]
    blocks = -(-size // BLOCK)

    def visits(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, place, lst = [], [], []
        for s in range(0, b.num_rows, CHUNK):
            near = np.argsort(lists.distances(lists.queries(matrix(b.column("v").slice(s, CHUNK)))), 1, kind="stable")
            held = np.cumsum(size[near], 1)
            rank = np.arange(count)[None]
            first = held - size[near] < 2 * k + 1
            wanted = (rank < np.ceil(lists.share * count)) | first
            i, j = np.nonzero(wanted & (size[near] > 0))
            ids.append(s + i)
            lst.append(near[i, j])
            place.append(first[i, j])
        at = pa.array(np.concatenate(ids))
        return pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(np.concatenate(lst).astype(np.int32)),
                                           pa.array(np.concatenate(place))], ["vec_id", "v", "list", "first"])

    asked = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    plan = map_batches(asked, visits, VECTOR + ", list int, first boolean")
    load = {(r[0], r[1]): r[2] for r in plan.groupBy("first", "list").count().collect()}  # two rows a list

    def meet(which: bool, bounds: DataFrame | None) -> DataFrame:
        chunks = np.array([max(1, -(-load.get((which, i), 0) // CHUNK)) for i in range(count)])
        used = [i for i in range(count) if load.get((which, i), 0)]

        def spread_rows(b: pa.RecordBatch, over: np.ndarray, own: np.ndarray, extra: list[str]) -> pa.RecordBatch:
            # a row goes to its own part of one side and is repeated for every part of the other
            lst, ids = b.column("list").to_numpy(), b.column("vec_id").to_numpy()
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            mine = (mix % np.maximum(own[lst], 1).astype(np.uint64)).astype(np.int32)
            times = over[lst]
            at = np.repeat(np.arange(b.num_rows), times)
            other = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
            cols = [b.column(c).take(pa.array(at)) for c in ("vec_id", "v", "list", *extra)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(mine[at]), pa.array(other)], ["vec_id", "v", "list", *extra, "mine", "other"])

        asks = plan.where(F.col("first") == which).select("vec_id", "v", "list")
        if bounds is None:
            asks = asks.withColumn("bound", F.lit(float("-inf")))
        else:
            asks = asks.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        asks = map_batches(asks, lambda b: spread_rows(b, blocks, chunks, ["bound"]), VECTOR + ", list int, bound double, chunk int, block int")
        needed = np.isin(np.arange(count), used)
        cands = map_batches(indexed, lambda b: spread_rows(b, np.where(needed, chunks, 0), blocks, []), VECTOR + ", list int, block int, chunk int")

        def together(ask: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(cand):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            qv, xv = np.stack(ask["v"].to_numpy()), np.stack(cand["v"].to_numpy())
            qi, xi = ask["vec_id"].to_numpy(), cand["vec_id"].to_numpy()
            # |q|^2 + length^2 - 2 score is the squared distance in the lifted space
            bound = (qv * qv).sum(1) + lists.length ** 2 - 2 * ask["bound"].to_numpy()
            got = []
            for s in range(0, len(qi), CHUNK):
                a, b = scan(lists.queries(qv[s:s + CHUNK]), lists.lifted(xv), qi[s:s + CHUNK, None] == xi[None], bound[s:s + CHUNK], k, margin)
                got.append((a + s, b))
            a, b = (np.concatenate(x) for x in zip(*got))
            score = np.concatenate([(qv[a[s:s + 65536]] * xv[b[s:s + 65536]]).sum(1) for s in range(0, max(len(a), 1), 65536)])
            top = best(a, xi[b], score, k)
            return pd.DataFrame({"query_id": qi[a[top]], "vec_id": xi[b[top]], "score": score[top]})

        keys = ["list", "block", "chunk"]
        return asks.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(together, out)

    def ranked(df: DataFrame) -> DataFrame:
        return top_per_key(df, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)

    near = cut(ranked(meet(True, None)))
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    both = near.drop("rank").unionByName(meet(False, bounds))
    return ranked(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
