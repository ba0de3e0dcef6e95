"""Near-duplicates by b-bit MinHash: bands propose pairs, packed low bits estimate them, full shingle sets confirm.

A text's set holds its distinct 5-word shingles.  ``BANDS`` bands of ``ROWS`` minima put equal ones in a bucket; a pair at
similarity 0.75 shares no bucket in about 2 of a million cases.  Of every minimum ``BITS`` low bits are kept; the share of
equal groups of bits, corrected for chance hits, estimates the similarity, and pairs more than four deviations under the
limit are dropped.  The rest are confirmed on full sets.

Texts with equal words form one class first, so exact copies cost one row each.  Then, in two rounds, links are sought:
every class with the bucket hub it shares most buckets with, and, inside buckets that still hold several components,
between members of different components.  Pairs inside one component are never looked at: they could not change it.

Buckets see packed bits only, never texts.  The members that have a close partner in one meet again in tiles, a zone (the
classes of one hub) with itself or what two zones have in common, and only there a text is sent, once a tile.

Defined cases: a text without words has an empty set and is linked with nothing; fewer than five words are one shingle;
rows with a null ``doc_id`` are linked with nothing and kept; rows that share a ``doc_id`` and not their words are texts of
their own, each with its own component; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from dealsight.llm.common import bit_of, bit_table, bits_set, cut, in_arrow, map_batches, release, texts
from dealsight.llm.graph import components, tiles

WORDS, LIMIT = 5, (75, 100)  # shingle length; links have intersection * 100 >= union * 75
BANDS, ROWS, BITS = 48, 5, 4
HASHES = BANDS * ROWS
CHANCE = 2.0 ** -BITS
BLOCK = 2048  # members of a bucket that are compared at once
CHUNK, CHUNK_SHINGLES = 4096, 1 << 19  # members and shingles of a zone that one tile takes of it
HUB_SHARE = 4096  # members that one task confirms against their hub
CACHE = 300_000
SHINGLES_KEPT = 600_000  # shingles, over all sets, that a task holds while it confirms
ODD = np.uint64(0x9E3779B97F4A7C15)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1234567)
    return rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def normal(text: bytes) -> list[bytes]:
    """Words with A-Z in small letters; the white space is that of the word pattern."""
    return text.lower().split()


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(normal(text)), digest_size=16).digest()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, WORDS)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed((h + ODD) * ODD ^ word_hashes[k:n - size + 1 + k])
    return np.unique(h)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(x), 2048):
        np.minimum(low, (x[s:s + 2048, None] * a + b).min(0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """The low bits of each minimum, four bits each, in whole 64-bit words."""
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (bits[0::2] << 4 | bits[1::2]).tobytes()


def band_hashes(low: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * ODD
    for k in range(ROWS):
        h = mixed(h ^ low.reshape(BANDS, ROWS)[:, k])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of rows of packed words, by bit counts."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
    return ((HASHES - differ) / HASHES - CHANCE) / (1 - CHANCE)


def floor_estimate(deviations: float = 4.3) -> float:
    """The lowest estimate that is still worth confirming."""
    hit = CHANCE + (1 - CHANCE) * LIMIT[0] / LIMIT[1]
    return LIMIT[0] / LIMIT[1] - deviations * np.sqrt(hit * (1 - hit) / HASHES) / (1 - CHANCE)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the words), n_shingles, packed low bits and band hashes of every row."""
    a, b_ = _permutations()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        seen: dict[bytes, tuple] = {}
        rows = []
        for text in texts(b):
            words = normal(text)
            key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            if key not in seen:
                if len(known) > CACHE:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                s = shingle_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                low = minima(s, a, b_)
                seen[key] = (key, len(s), packed(low) if len(s) else None, band_hashes(low) if len(s) else None)
            rows.append(seen[key])
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                                          ["doc_id", "key", "n_shingles", "sig", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), batch,
                       "doc_id long, key binary, n_shingles long, sig binary, bands array<long>")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets of a partition that is sorted by bucket, some batches' worth at a time."""
    held: list[pa.RecordBatch] = []

    def table() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = table()
        keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
        if len(change):
            at = int(change[-1]) + 1
            yield t.slice(0, at)
            held = t.slice(at).combine_chunks().to_batches()
    if held:
        yield table()


def close_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one bucket in different components whose estimate and sizes allow a link, a share at a time."""
    least = floor_estimate()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u8").reshape(len(t), -1)
    bucket, lo, hi, block, comp, n = (t.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "comp", "n"))
    at, d = np.arange(len(t)), 0
    while len(at):
        d += 1
        at = at[at + d < len(t)]
        to = at + d
        same = (bucket[at] == bucket[to]) & (lo[at] == lo[to]) & (hi[at] == hi[to])
        at, to = at[same], to[same]
        ok = (comp[at] != comp[to]) & ((lo[at] == hi[at]) | (block[at] != block[to]))
        ok &= np.minimum(n[at], n[to]) * LIMIT[1] >= np.maximum(n[at], n[to]) * LIMIT[0]
        i, j = at[ok], to[ok]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            live = estimate(sig[p], sig[q]) >= least
            yield p[live], q[live]


MEMBER = "bucket long, lo int, hi int, block int, node long, comp long, zone long, n long, sig binary"


def with_partner(members: DataFrame) -> DataFrame:
    """(z1, z2, side, rep): members with a close pair in their bucket, by the zones of both; big buckets meet in blocks, two
    blocks at a time.  Only packed bits move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches):
            node, zone = t.column("node").to_numpy(), t.column("zone").to_numpy()
            met = [np.zeros((0, 4), np.int64)]
            for i, j in close_pairs(t):
                for x, y in ((i, j), (j, i)):
                    a, b = zone[x], zone[y]
                    met.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), a > b, node[x]], 1), axis=0))
            found = np.unique(np.concatenate(met), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 3])], ["z1", "z2", "side", "rep"])

    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    m = members.withColumn("block", F.when(blocks == 1, 0).otherwise(F.pmod(F.xxhash64("node"), blocks)).cast("int"))
    m = m.withColumn("_t", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.withColumn("lo", F.least("block", "_t")).withColumn("hi", F.greatest("block", "_t"))
    m = m.select(*[c.split()[0] for c in MEMBER.split(", ")]).repartition("bucket", "lo", "hi")
    return in_arrow(m.sortWithinPartitions("bucket", "lo", "hi"), run, "z1 long, z2 long, side int, rep long").distinct()


def exact_ids(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, id) of every distinct shingle of the texts; equal shingles, and only those, have equal ids."""
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known) + 1) for w in normal(t)] for t in found]
    base = len(known) + 1
    n = np.array([len(w) for w in words])
    padded = np.concatenate([np.array(w + [0] * (WORDS - 1), np.int64) for w in words])  # 0 ends a text of fewer words
    starts = np.cumsum(n + WORDS - 1) - n - WORDS + 1
    count = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(len(found)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    ids = padded[at]
    for k in range(1, WORDS):
        ids = np.unique(ids * base + padded[at + k], return_inverse=True)[1]
    both = np.unique(owner * (ids.max(initial=0) + 1) + ids)
    return both // (ids.max(initial=0) + 1), both % (ids.max(initial=0) + 1)


def tile_links(members: DataFrame) -> DataFrame:
    """(a, b): confirmed links between components that meet in a tile, as many as join them and no more.

    A member is estimated against all before it; if one of another component is close, its overlaps with all are counted
    by the lists of its shingles.
    """
    least = floor_estimate()

    def tile(at: list[int], rows: list[tuple]) -> list[tuple[int, int]]:
        node, side, comp, sigs, found = zip(*rows)
        m = len(rows)
        side, sig = np.array(side), np.frombuffer(b"".join(sigs), "<u8").reshape(m, -1)
        across = at[0] != at[1] or at[2] != at[3]
        owner, ids = exact_ids(list(found))
        n = np.bincount(owner, minlength=m)
        begin = np.concatenate([[0], np.cumsum(n)])
        df = np.bincount(ids)
        start = np.cumsum(df) - df
        full = owner[np.argsort(ids, kind="stable")]
        names = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        group = np.array([names[c] for c in comp])  # components as they are joined in this tile
        links = []
        for x in range(1, m):
            open_ = np.flatnonzero((group[:x] != group[x]) & (np.minimum(n[:x], n[x]) * LIMIT[1] >= np.maximum(n[:x], n[x]) * LIMIT[0]))
            if across:
                open_ = open_[side[open_] != side[x]]
            open_ = open_[estimate(sig[open_], sig[x][None]) >= least]
            if not len(open_):
                continue
            mine = ids[begin[x]:begin[x + 1]]
            sizes = df[mine]
            ends = np.cumsum(sizes)
            both = np.bincount(full[np.repeat(start[mine] - (ends - sizes), sizes) + np.arange(ends[-1])], minlength=m)
            for y in open_[both[open_] * (LIMIT[0] + LIMIT[1]) >= (n[open_] + n[x]) * LIMIT[0]].tolist():
                if group[y] != group[x]:
                    links.append((node[x], node[y]))
                    group[group == group[y]] = group[x]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, links = [], None, []
        for b in batches:
            for *at, node, side, comp, sig, text in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)]):
                if at != now and held:
                    links += tile(now, held)
                    held = []
                now = at
                held.append((node, side, comp, sig, text))
        if held:
            links += tile(now, held)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], ["a", "b"])

    at = ["z1", "z2", "i", "j"]
    rows = members.select(*at, "node", "side", "comp", "sig", "text").repartition(*at)
    return in_arrow(rows.sortWithinPartitions(*at), run, "a long, b long")


class Sets:
    """Full shingle sets of texts, each shingle as one number made of its words' numbers.

    All is forgotten when the sets hold more than SHINGLES_KEPT shingles; they are made again when asked for.
    """

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.known: dict[int, set[int]] = {}
        self.size = 0

    def of(self, rep: int, text: Callable[[], bytes]) -> set[int]:
        got = self.known.get(rep)
        if got is None:
            words = self.words
            ids = [words.setdefault(w, len(words)) for w in normal(text())]
            if len(ids) < WORDS:
                got = {sum(n << 32 * k for k, n in enumerate(ids)) + (len(ids) << 32 * WORDS)} if ids else set()
            else:
                got = {a << 128 | b << 96 | c << 64 | d << 32 | e for a, b, c, d, e in zip(*(ids[k:] for k in range(WORDS)))}
            self.known[rep] = got
            self.size += len(got)
        return got

    def forget(self) -> None:
        if self.size > SHINGLES_KEPT:
            self.__init__()

    def linked(self, a: int, ta: Callable[[], bytes], b: int, tb: Callable[[], bytes]) -> bool:
        self.forget()
        x, y = self.of(a, ta), self.of(b, tb)
        both = len(x & y)
        return LIMIT[1] * both >= LIMIT[0] * (len(x) + len(y) - both)


def hub_links(star: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (node, hub) of ``star`` whose full shingle sets are similar enough; ``known`` has (node, text) of all of them.

    A hub's text goes once to each share of its members and is met first there; members stream past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, hub, hub_text, found = Sets(), None, None, []
        for b in batches:
            for h, own, node, text in zip(*[b.column(c).to_pylist() for c in ("hub", "own", "node", "text")]):
                if not own:
                    hub, hub_text = h, text
                elif hub == h and sets.linked(h, lambda: hub_text, node, lambda: text):
                    found.append((node, h))
            sets.forget()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])

    shares = star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_SHARE).cast("int").alias("s"))
    rows = star.join(shares, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("s")).cast("int").alias("share"), F.lit(1).alias("own"), "node")
    hubs = shares.select("hub", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("share"), F.lit(0).alias("own"), F.col("hub").alias("node"))
    rows = rows.unionByName(hubs).join(known, "node").repartition("hub", "share").sortWithinPartitions("hub", "share", "own")
    return in_arrow(rows, run, "a long, b long")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the classes in ``wanted`` (node, rep, key); a bit table of their ids skips most other texts."""
    bits, table = bit_table(wanted, "rep")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        some = b.filter(pa.array(bits_set(table, b.column("_bit").to_numpy())))
        if not some.num_rows:
            return None
        return pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text").cast(pa.binary()), pa.array(list(map(digest, texts(some))))], ["rep", "text", "key"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    some = map_batches(rows.withColumn("_bit", bit_of("doc_id", bits)), batch, "rep long, text binary, key binary")
    return some.join(wanted, ["rep", "key"]).dropDuplicates(["node"]).select("node", "text")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the words), n_shingles, component_id, kept of every row."""
    sketch = cut(sketches(docs))
    rows = cut(sketch.select("doc_id", "key", "n_shingles"))
    live = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    first = F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("f")
    found = live.groupBy("key").agg(first).select("key", F.col("f.doc_id").alias("rep"), F.col("f.n_shingles").alias("n"), "f.sig", "f.bands")
    found = cut(found)
    release(sketch)
    # a class is named by its smallest id; of several classes with one smallest id, all but one by a hash
    named = found.groupBy("rep").agg(F.min("key").alias("_key"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    node = F.when(F.col("_key").isNull() | (F.col("key") == F.col("_key")), F.col("rep")).otherwise(F.xxhash64("key", "rep"))
    known = found.join(cut(named), "rep", "left").withColumn("node", node).drop("_key")
    classes = cut(known.select("node", "rep", "key", "n", "sig"))

    buckets = cut(known.select("node", F.explode("bands").alias("bucket")))
    release(found)
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1")
    members = cut(buckets.join(sizes, "bucket"))
    release(buckets)

    # round one: the hub with which a class shares most buckets
    shared = members.where(F.col("node") != F.col("hub")).groupBy("node", "hub").count()
    star = cut(shared.groupBy("node").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")))
    ends = star.select("node").union(star.select("hub")).distinct()
    links = cut(hub_links(star, class_texts(docs, cut(classes.join(ends, "node", "left_semi").select("node", "rep", "key")))))
    comps = components(links)

    # round two: members of one bucket that are still in different components
    placed = members.drop("hub").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    split = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
    open_ = placed.join(split, "bucket", "left_semi").join(star.withColumnRenamed("hub", "zone"), "node", "left").withColumn("zone", F.coalesce("zone", "node"))
    met = cut(with_partner(open_.join(classes.select("node", "n", "sig"), "node")))
    release(members)
    dealt = cut(tiles(met.join(classes.select(F.col("node").alias("rep"), "n"), "rep"), CHUNK, CHUNK_SHINGLES).withColumnRenamed("rep", "node"))
    ends = cut(classes.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "rep", "key"))
    side = dealt.join(classes.select("node", "sig"), "node").join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    comps = components(links.unionByName(tile_links(side.join(class_texts(docs, ends), "node"))))

    named = classes.select("node", "rep", "key").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("_c"))
    out = rows.join(named.join(least, "component").select("key", "_c"), "key", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_c")))
    return out.select("doc_id", "key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return components_of(docs).drop("key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that are kept, one row for each (``doc_id``, words); rows without a ``doc_id`` all stay.

    Only rows whose id is among those dropped or repeated are looked up, and move for it; all other rows stay where they are.
    Of rows that repeat id and words the one with the smallest text stays.
    """
    found = components_of(docs).where(F.col("doc_id").isNotNull()).groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    touched = cut(found.where(~F.col("kept") | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "kept"))
    bits, table = bit_table(touched, "_id")
    named = ["c" + str(k) for k in range(len(docs.columns))]  # plain names: the columns' own may clash or hold dots
    place = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.toDF(*named)
    doc, text = (f"c{k}" for k in place)
    at = F.when(F.col(doc).isNotNull(), bit_of(F.col(doc).cast("long"), bits)).otherwise(F.lit(-1).cast("long"))
    rows = rows.withColumn("_bit", at)

    def hit(b: pa.RecordBatch) -> np.ndarray:
        bit = b.column("_bit").to_numpy()
        return (bit >= 0) & bits_set(table, np.maximum(bit, 0))

    def clear(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(~hit(b))).drop_columns(["_bit"])

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        some = b.filter(pa.array(hit(b))).drop_columns(["_bit"])
        return some.append_column("_key", pa.array(list(map(digest, texts(some, text))), pa.binary()))

    schema = docs.toDF(*named).schema
    free = map_batches(rows, clear, schema)
    looked = map_batches(rows, keyed, T.StructType([*schema.fields, T.StructField("_key", T.BinaryType())]))
    looked = looked.withColumnRenamed("_key", "_k").join(touched, (F.col(doc).cast("long") == F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    rest = looked.where("kept IS NULL").select(*named)
    again = looked.where("kept").groupBy("_id", "_key").agg(F.min_by(F.struct(*named), F.coalesce(F.col(text), F.lit(""))).alias("r")).select("r.*")
    return free.unionByName(rest).unionByName(again).toDF(*docs.columns)
