"""Ranked lexical search with bit-sliced Bloom signatures: upper bounds first, exact scores for what they cannot exclude.

Every document gets a Bloom signature of its terms.  Signatures of one width are kept in groups of documents and cut
across: slice k holds bit k of every document of the group, so a few slices, and-ed, tell which documents may hold a term.
A term that occurs at least 2 or 4 times has further keys in the same signature.  Signatures overestimate, so for an item
the sums of the weights of its terms over these bitmaps, multiplied by what one, three and the most occurrences can score
at the document's length, are upper bounds.

A first scan of the slices takes the documents with the highest bounds for each item and scores them exactly; the tenth
of these scores is a floor.  A second scan takes every document whose bound reaches the floor; those are scored exactly
from their texts.  No other document can be among the ten.  There is no cap on what is scored again.

Items are taken in blocks of at most ``ITEMS`` rows and about ``TERMS`` terms; what travels to the tasks (terms, weights,
floors) is bounded by that.  Slices stay where they were made; texts are read again, and joined with the wanted documents,
which are broadcast up to ``SMALL`` rows and shuffled beyond.

Defined cases: a null text has no terms; such documents count nowhere.  Rows that share a ``doc_id`` are documents of
their own, and a null ``doc_id`` comes last among ties.  Items of equal id and text are one item, items without terms have
no rows.  A term's weight is 0 where nearly all documents hold it.  Empty tables give no rows.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dealsight.functions.scale import top_per_key
from dealsight.llm.common import cut, in_arrow, map_batches, texts

TOP = 10
ITEMS, TERMS = 512, 1 << 16
HASHES, KEY_BITS = 3, 8  # slices a key sets, signature bits a key
NARROW, WIDE = 1 << 8, 1 << 20  # signature widths; one that is too narrow only loosens bounds
GROUP, GROUP_BITS = 512, 1 << 24  # documents in a group, bits in its slices
SMALL = 50_000
PIECE = 4096  # (item, term) pairs summed at once
CACHE = 500_000
#: ASCII letters in small, digits, and everything beyond ASCII; all else separates terms.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def level_keys(h: np.ndarray) -> list[np.ndarray]:
    """Keys for at least one, two and four occurrences."""
    return [spread(h + np.uint64(k)) for k in (1, 2, 3)]


def slots(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The slices that each key sets, by 20 bits of it each."""
    return [((keys >> np.uint64(20 * k)) & np.uint64(width - 1)).astype(np.int64) for k in range(HASHES)]


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


INDEX = "ids array<long>, digests array<long>, sizes array<long>, most array<long>, width long, slices binary"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"))


def index(docs: DataFrame) -> DataFrame:
    """Groups of documents with their sizes, highest term counts and signature slices."""

    def group(width: int, held: list[tuple]) -> pa.RecordBatch:
        bits = np.zeros((width, -(-len(held) // 8) * 8), bool)
        for k, row in enumerate(held):
            for at in slots(row[4], width):
                bits[at, k] = True
        ids, digests, sizes, most, _ = zip(*held)
        columns = [pa.array([list(c)], pa.list_(pa.int64())) for c in (ids, digests, sizes, most)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([width]), pa.array([np.packbits(bits, axis=1, bitorder="little").tobytes()], pa.binary())],
                                          ["ids", "digests", "sizes", "most", "width", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for text, doc, digest in zip(texts(b), b.column("doc_id").to_pylist(), b.column("digest").to_pylist()):
                counts = Counter(terms(text))
                if not counts:
                    continue
                if len(known) > CACHE:
                    known.clear()
                for w in set(counts).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                h = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                one, two, four = level_keys(h)
                keys = np.concatenate([one, two[tf >= 2], four[tf >= 4]])
                width = min(WIDE, max(NARROW, 1 << (KEY_BITS * len(keys) - 1).bit_length()))
                rows = held.setdefault(width, [])
                rows.append((doc, digest, int(tf.sum()), int(tf.max()), keys))
                if len(rows) >= min(GROUP, GROUP_BITS // width):
                    yield group(width, held.pop(width))
        for width, rows in held.items():
            yield group(width, rows)

    return in_arrow(keyed(docs), run, INDEX)


class Block:
    """Items with their terms: what the tasks need of them."""

    def __init__(self, items: list[set[bytes]]) -> None:
        self.words = sorted(set().union(*items))
        self.place = {w: k for k, w in enumerate(self.words)}
        self.items = [sorted(self.place[w] for w in found) for found in items]
        self.keys = level_keys(np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64))
        self.terms = np.array([t for found in self.items for t in found], np.int64)
        self.owners = np.repeat(np.arange(len(items)), [len(found) for found in self.items])
        self.weights = np.zeros(len(self.words), np.int64)
        self.n = self.total = 0

    def weigh(self, df: dict[int, int], n: int, total: int) -> None:
        self.n, self.total = n, total
        for k in range(len(self.words)):
            self.weights[k] = math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(k, 0) + 1)))

    def length(self, sizes: np.ndarray) -> np.ndarray:
        return 10 + (90 * sizes * self.n) // self.total

    def bounds(self, sizes: np.ndarray, most: np.ndarray, width: int, slices: bytes) -> np.ndarray:
        """Upper bounds: a row for each item, a column for each document of the group."""
        bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
        maps, held = [], None
        for keys in self.keys:
            here = reduce(np.bitwise_and, [bits[at] for at in slots(keys, width)])
            held = here if held is None else held & here
            maps.append(held)
        m = self.length(sizes)
        once, thrice = gain(np.ones_like(m), m), gain(np.minimum(most, 3), m)
        steps = [once, np.where(most >= 2, thrice - once, 0), np.where(most >= 4, gain(most, m) - thrice, 0)]
        live = (maps[0].any(1) & (self.weights > 0))[self.terms]
        out = np.zeros((len(self.items), len(sizes)), np.int64)
        owner, at = self.owners[live], self.terms[live]
        for s in range(0, len(at), PIECE):  # an item may go on in the next piece
            who, some = owner[s:s + PIECE], at[s:s + PIECE]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            for bitmap, step in zip(maps, steps):
                if step.any():
                    seen = np.unpackbits(bitmap[some], axis=1, bitorder="little", count=len(sizes))
                    out[who[starts]] += np.add.reduceat(seen * self.weights[some, None], starts, axis=0) * step
        return out


def document_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """Documents holding each term of the block."""
    place = block.place
    wanted = frozenset(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for b in batches:
            for text in texts(b):
                found.update(wanted.intersection(terms(text)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([place[w] for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counts = in_arrow(docs.select("text").where(F.col("text").isNotNull()), run, "term long, n long")
    return {r[0]: r[1] for r in counts.groupBy("term").agg(F.sum("n")).collect()}  # at most one row for each term of the block


def columns_of(b: pa.RecordBatch) -> Iterator[tuple]:
    for k in range(b.num_rows):
        ids, digests, sizes, most = (b.column(c)[k].as_py() for c in ("ids", "digests", "sizes", "most"))
        yield np.array(ids, object), np.array(digests, np.int64), np.array(sizes, np.int64), np.array(most, np.int64), b.column("width")[k].as_py(), b.column("slices")[k].as_py()


def highest(slices: DataFrame, block: Block, keep: int) -> DataFrame:
    """(doc_id, digest, items): for each task and item, the documents with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.items)
        bound, ids, digests = np.zeros((n, 0), np.int64), np.zeros((n, 0), object), np.zeros((n, 0), np.int64)
        for b in batches:
            for doc, digest, sizes, most, width, bits in columns_of(b):
                bound = np.concatenate([bound, block.bounds(sizes, most, width, bits)], 1)
                ids, digests = (np.concatenate([old, np.broadcast_to(new, (n, len(new)))], 1) for old, new in ((ids, doc), (digests, digest)))
                if bound.shape[1] > keep:
                    at = np.argpartition(-bound, keep - 1, axis=1)[:, :keep]
                    bound, ids, digests = (np.take_along_axis(x, at, 1) for x in (bound, ids, digests))
        item, at = np.nonzero(bound)
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(bound[item, at]), pa.array(ids[item, at].tolist(), pa.int64()), pa.array(digests[item, at])],
                                             ["item", "bound", "doc_id", "digest"])

    found = in_arrow(slices, run, "item int, bound long, doc_id long, digest long").dropDuplicates(["item", "doc_id", "digest"])
    found = top_per_key(found, ["item"], [F.col("bound").desc(), F.col("doc_id"), F.col("digest")], keep)
    return found.groupBy("doc_id", "digest").agg(F.collect_list("item").alias("items"))


def reaching(slices: DataFrame, block: Block, floors: np.ndarray) -> DataFrame:
    """(doc_id, digest, items): every document with the items whose floor its bound reaches."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, digests, items = [], [], []
        for doc, digest, sizes, most, width, bits in columns_of(b):
            hit = block.bounds(sizes, most, width, bits) >= floors[:, None]
            for k in np.flatnonzero(hit.any(0)):
                docs.append(doc[k])
                digests.append(digest[k])
                items.append(np.flatnonzero(hit[:, k]))
        if not docs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digests, pa.int64()), pa.array(items, pa.list_(pa.int32()))], ["doc_id", "digest", "items"])

    return map_batches(slices, batch, "doc_id long, digest long, items array<int>").dropDuplicates(["doc_id", "digest"])


def scores(docs: DataFrame, wanted: DataFrame, block: Block) -> DataFrame:
    """(item, doc_id, score): exact scores above 0 of the wanted documents for their items."""
    side = wanted.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "items")
    if side.limit(SMALL + 1).count() <= SMALL:
        side = F.broadcast(side)
    rows = keyed(docs)
    rows = rows.join(side, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["digest"] == F.col("_g"))).select("doc_id", "text", "items")
    weights = block.weights.tolist()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        item, at, found = [], [], []
        for k, (text, items) in enumerate(zip(texts(b), b.column("items").to_pylist())):
            counts = Counter(terms(text))
            m = 10 + (90 * counts.total() * block.n) // block.total
            for i in items:
                score = 0
                for t in block.items[i]:
                    tf = counts.get(block.words[t])
                    if tf:
                        score += weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                if score:
                    item.append(i)
                    at.append(k)
                    found.append(score)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], ["item", "doc_id", "score"])

    return map_batches(rows, batch, "item int, doc_id long, score long")


def best(found: DataFrame, top: int) -> DataFrame:
    return top_per_key(found, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], top)


def search_block(docs: DataFrame, slices: DataFrame, block: Block, top: int) -> DataFrame:
    """(item, doc_id, score, rank) for the items of one block; ``block`` has its weights."""
    first = best(scores(docs, cut(highest(slices, block, top)), block), top)
    floors = np.ones(len(block.items), np.int64)
    for r in first.where(F.col("rank") == top).select("item", "score").collect():  # at most one row an item
        floors[r[0]] = r[1]
    return best(scores(docs, cut(reaching(slices, block, floors)), block), top)


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[set[bytes]]]]:
    """Ids and term sets of the items, a block at a time."""
    ids, found, size = [], [], 0
    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").distinct().toLocalIterator():
        words = set(terms(r[1].encode()))
        if words:
            if ids and (len(ids) >= ITEMS or size + len(words) > TERMS):
                yield ids, found
                ids, found, size = [], [], 0
            ids.append(r[0])
            found.append(words)
            size += len(words)
    if ids:
        yield ids, found


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents for each item."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    slices = cut(index(docs))
    n, total = slices.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for ids, found in item_blocks(items) if n else ():
        block = Block(found)
        block.weigh(document_counts(docs, block), n, total)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind.simpleString()}")
        ranked = search_block(docs, slices, block, top).join(F.broadcast(names), "item")  # at most ITEMS names
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
