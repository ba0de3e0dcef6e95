"""Jaccard join of 5-word shingle sets at 80 %, with set-relation skipping.

Texts with equal sets are one class.  Shingles are ordered by how common they are, rarest first; two sets at 80 % share a
shingle among the first fifth of each, so only these prefixes enter inverted lists.

*Index level.*  In a list, the sets of one zone form a block with its sizes and positions.  A set meets a block only if a
size in it is near enough and its positions leave enough shingles; other blocks are skipped whole.  A set's zone is the
smallest member of the lists it shares most often, so copies and variants of a text fall into one zone, and it is blocks
and not pairs that meet.

*Answer level.*  Sets that met are joined in tiles: a zone with itself, or what two zones have in common.  A tile has its own
inverted lists, ordered by what a position leaves, and a probe stops where that is too little.  The first set that finds a
candidate counts its overlaps with all sets of the tile.  A set that differs from such a leader by at most a quarter takes
over the leader's overlaps and corrects them only by the lists of the shingles in which both differ.

Before sets are sent to a tile, it sees their histograms: how many shingles of a set fall into each of about n / 3 buckets of
the hash.  The sum of the smaller counts is never less than the intersection, so a set none of whose sums reaches what a link
needs leaves the tile.

A tile reports each set's number of links and the links that join its components, never all pairs.  Zones over ``CHUNK`` sets
or ``CHUNK_SHINGLES`` shingles are dealt into chunks, and every two chunks meet in a task of their own.  Nothing is capped.

The order comes from a table of fixed size that counts the shingles by hash bucket; any order gives the same links, a bad one
only costs time.  Shingles are 64-bit hashes; they are compared, not the texts, so two of them that collide would count as
equal (for a billion distinct shingles in all, about 1 pair in 40 tables).

Defined cases: a text without words has an empty set and is linked with nothing; fewer than five words are one shingle; a
null ``doc_id`` is linked with nothing and has no component; rows that share a ``doc_id`` are one document whose links are
those of all its texts; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import bit_of, bit_table, bits_set, cut, in_arrow, release, texts
from dealsight.llm.graph import components, tiles
from dealsight.llm.minhash import normal, shingle_hashes

PART, WHOLE = 80, 100  # links have intersection * WHOLE >= union * PART
BUCKETS, PIECE = 1 << 20, 1 << 12  # counters of the table of common shingles; counters in a row of it
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
CACHE = 300_000


class Shingles:
    """Shingle sets of texts as sorted 64-bit hashes; words are hashed once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = normal(text)
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return shingle_hashes(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Shingles by the low bits of their hash, in n / 4 to n / 2 buckets, a power of two and 16 at least."""
    size = max(16, 1 << (len(shingles) // 2).bit_length() >> 1)
    return np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype("<u2")


def prefix_length(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def least_overlap(n, m):
    """The smallest intersection of linked sets of these sizes."""
    return -(-PART * (n + m) // (PART + WHOLE))


def commonness(docs: DataFrame) -> np.ndarray:
    """For every hash bucket: 0, or the logarithm of its count if it stands out.  ``BUCKETS`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, table, held, size = Shingles(), np.zeros(BUCKETS, np.int64), [], 0
        for b in batches:
            for text in texts(b):
                held.append(bucket(shingles.of(text)))
                size += len(held[-1])
                if size > BUCKETS:
                    table += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held), minlength=BUCKETS)
        parts = [p.astype("<u4").tobytes() for p in np.split(table, BUCKETS // PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist()):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()])], ["piece", "counts"])

    form = "piece int, counts binary"
    counts = np.zeros(BUCKETS, np.int64)
    for r in in_arrow(in_arrow(docs.select("text").where(F.col("text").isNotNull()), count, form).repartition("piece"), add, form).toLocalIterator():
        counts[r[0] * PIECE:(r[0] + 1) * PIECE] = np.frombuffer(r[1], np.int64)
    usual = counts.mean()
    return np.where(counts > usual + 6 * np.sqrt(usual) + 8, np.ceil(np.log2(np.maximum(counts, 2))), 0).astype(np.uint8)


def sketches(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, key (digest of the set), n, its prefix in order, how many of the prefix are not common, and its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for b in batches:
            rows = []
            for text in texts(b):
                s = shingles.of(text)
                kind = common[bucket(s)]
                k = prefix_length(len(s)) if len(s) else 0
                first = np.lexsort((s, kind))[:k]
                rows.append((digest(s), len(s), s[first].view(np.int64), int((kind[first] == 0).sum()), histogram(s).tobytes()))
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", "key", "n", "prefix", "rare", "hist"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, key binary, n long, prefix array<long>, rare int, hist binary")


def shared_entries(classes: DataFrame) -> DataFrame:
    """(token, rep, n, pos, hub): list entries of shingles that two classes or more have in their prefixes.

    Rare shingles have short lists: they are sorted and read as runs.  The common ones are counted before they are joined.
    """
    entries = classes.select("rep", "n", "rare", F.posexplode("prefix").alias("pos", "token"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["token", "rep", "n", "pos", "hub"]

        def out(x: np.ndarray) -> pa.RecordBatch | None:
            new = np.r_[True, x[0, 1:] != x[0, :-1]]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, x.shape[1]])
            hub, size = np.repeat(x[1, start], size), np.repeat(size, size)
            live = size > 1
            return pa.RecordBatch.from_arrays([pa.array(c[live]) for c in (x[0], x[1], x[2] >> 32, x[2] & 0xFFFFFFFF, hub)], names) if live.any() else None

        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(k).to_numpy() for k in range(3)])
            x = x if held is None else np.concatenate([held, x], 1)
            last = np.flatnonzero(x[0] != x[0, -1])
            at = last[-1] + 1 if len(last) else 0
            held = x[:, at:]
            if at and (r := out(x[:, :at])):
                yield r
        if held is not None and (r := out(held)):
            yield r

    form = "token long, rep long, n long, pos long, hub long"
    rare = entries.where("pos < rare").select("token", "rep", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    rare = in_arrow(rare.repartition("token").sortWithinPartitions("token", "rep"), runs, form)
    often = entries.where("pos >= rare").select("token", "rep", "n", F.col("pos").cast("long").alias("pos"))
    hubs = often.groupBy("token").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    return rare.unionByName(often.join(hubs, "token"))


def meetings(live: DataFrame, sizes: DataFrame) -> DataFrame:
    """(z1, z2, side, rep): the sets that meet in a tile; a zone meets itself, and another one where blocks of a list fit."""
    votes = live.groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("v"))
    zones = cut(votes.groupBy("rep").agg(F.max_by("hub", F.struct("v", -F.col("hub"))).alias("zone")))
    own = zones.select(F.col("zone").alias("z1"), F.col("zone").alias("z2"), F.lit(0).alias("side"), "rep")
    placed = live.join(zones, "rep")
    split = placed.groupBy("token").agg(F.min("zone").alias("_a"), F.max("zone").alias("_b")).where("_a < _b").select("token")
    placed = cut(placed.join(split, "token", "left_semi").select("token", "rep", "n", (F.col("n") - F.col("pos")).alias("rest"), "zone"))
    blocks = placed.groupBy("token", F.col("zone").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("left"))
    near = (F.col("most") * WHOLE >= F.col("n") * PART) & (F.col("least") * PART <= F.col("n") * WHOLE)
    enough = F.least("rest", "left") * (PART + WHOLE) >= (F.col("n") + F.col("least")) * PART
    met = placed.join(blocks, "token").where((F.col("zone") != F.col("other")) & near & enough)
    met = met.select(F.least("zone", "other").alias("z1"), F.greatest("zone", "other").alias("z2"), (F.col("zone") > F.col("other")).cast("int").alias("side"), "rep").distinct()
    return own.unionByName(met).join(sizes, "rep")


def by_tile(batches: Iterator[pa.RecordBatch], fn: Callable[[list[int], list[tuple]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``fn`` on the rows of each tile of a partition that is sorted by the first four columns."""
    held, now = [], None
    for b in batches:
        for row in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)]):
            if row[:4] != now and held:
                if (r := fn(now, held)):
                    yield r
                held = []
            now = row[:4]
            held.append(row[4:])
    if held and (r := fn(now, held)):
        yield r


TILE = ["z1", "z2", "i", "j"]


def within(at: tuple) -> bool:
    """Whether a tile joins one chunk with itself."""
    return at[0] == at[1] and at[2] == at[3]


def may_link(hists: list[np.ndarray], n: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Which sets have a partner whose histogram leaves room for a link."""
    width = np.array([len(h) for h in hists])
    hit = np.zeros(len(n), bool)
    for size in np.unique(width):
        # sizes of linked sets differ by a quarter, so widths by a factor of two at most
        some = np.flatnonzero((width == size) | (width == 2 * size))
        table = np.stack([hists[k].reshape(-1, size).sum(0) for k in some])
        for x in np.flatnonzero(width[some] == size):
            me = some[x]
            ok = (n[some] * WHOLE >= n[me] * PART) & (n[some] * PART <= n[me] * WHOLE) & (some != me)
            if side is not None:
                ok &= side[some] != side[me]
            if hit[me]:
                ok &= ~hit[some]
            at = np.flatnonzero(ok)
            if len(at):
                at = at[np.minimum(table[at], table[x]).sum(1) >= least_overlap(n[some[at]], n[me])]
                hit[some[at]] = True
                hit[me] |= len(at) > 0
    return hit


def survivors(dealt: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of the tiles (with key and c) that may have a link in them."""

    def tile(at: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        side, rep, key, c, n, hists = zip(*rows)
        hit = may_link([np.frombuffer(h, "<u2").astype(np.int64) for h in hists], np.array(n), None if within(at) else np.array(side))
        some = np.flatnonzero(hit).tolist()
        if not some:
            return None
        columns = [pa.array([at[k]] * len(some), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        columns += [pa.array([col[k] for k in some], t) for col, t in ((side, pa.int32()), (rep, pa.int64()), (key, pa.binary()), (c, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [*TILE, "side", "rep", "key", "c"])

    rows = dealt.join(classes.select("rep", "key", "c", "n", "hist"), "rep").select(*TILE, "side", "rep", "key", "c", "n", "hist").repartition(*TILE)
    return in_arrow(rows.sortWithinPartitions(*TILE), lambda b: by_tile(b, tile), "z1 long, z2 long, i int, j int, side int, rep long, key binary, c long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, key, shingles), perhaps repeatedly, of the wanted reps and some others; a bit table skips most other texts."""
    bits, table = bit_table(wanted, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for b in batches:
            some = b.filter(pa.array(bits_set(table, b.column("_bit").to_numpy())))
            for k, text in enumerate(texts(some)):  # one row at a time: sets may be long
                s = shingles.of(text)
                if len(s):
                    yield pa.RecordBatch.from_arrays([some.column("rep").slice(k, 1), pa.array([digest(s)]), pa.array([s.tobytes()], pa.binary())], ["rep", "key", "shingles"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("rep"), "text")
    return in_arrow(rows.withColumn("_bit", bit_of("rep", bits)), run, "rep long, key binary, shingles binary")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def join_tile(sets: list[np.ndarray], side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, its linked sets before it in order of size) by the two kinds of skipping.  ``side``: only unlike sides are joined."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, m = n[order], len(sets)
    owner = np.repeat(np.arange(m), n)
    tokens, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    df = np.bincount(ids)
    by_df = np.argsort(df, kind="stable")
    rank = np.empty_like(by_df)
    rank[by_df] = np.arange(len(by_df))
    ids, df = rank[ids], df[by_df]  # shingles numbered from the rarest here
    at = np.lexsort((ids, owner))
    ids, owner = ids[at], owner[at]
    begin = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(len(ids)) - begin[owner]
    shared = df[ids] > 1
    start = np.concatenate([[0], np.cumsum(df)])  # full lists, by shingle
    full = owner[np.argsort(ids, kind="stable")]
    inside = shared & (pos < (n - -(-PART * n // WHOLE) + 1)[owner])
    rest = (n[owner] - pos)[inside]
    order_in = np.lexsort((-rest, ids[inside]))
    p_ids, p_own, p_rest = ids[inside][order_in], owner[inside][order_in], rest[order_in]
    p_start, p_end = np.searchsorted(p_ids, np.arange(len(df))), np.searchsorted(p_ids, np.arange(len(df)), "right")
    # lists lie one after another, and fall within each: one sorted array serves all searches
    spot = p_ids * (n[-1] + 1) + (n[-1] - p_rest)
    leaders: dict[int, np.ndarray] = {}
    led = np.full(m, -1)

    def counted(t: np.ndarray) -> np.ndarray:
        return np.bincount(full[ranges(start[t], df[t])], minlength=m)

    for x in range(m):
        mine = ids[begin[x]:begin[x + 1]]
        least = least_overlap(n[x], -(-PART * n[x] // WHOLE))
        k = np.arange(min(prefix_length(int(n[x])), n[x]))
        probe = mine[k[(n[x] - k >= least) & (df[mine[k]] > 1)]]
        if not len(probe):
            continue
        stop = np.searchsorted(spot, probe * (n[-1] + 1) + (n[-1] - least), "right")  # blocks of lower rest are skipped
        sizes = np.maximum(stop - p_start[probe], 0)
        seen = p_own[ranges(p_start[probe], sizes)]
        seen = seen[seen != x]
        seen = seen[(n[seen] * WHOLE >= n[x] * PART) & (n[seen] * PART <= n[x] * WHOLE)]
        if not len(seen):
            continue
        mine = mine[df[mine] > 1]
        hits = np.bincount(led[seen[led[seen] >= 0]], minlength=1)
        leader, overlap = int(hits.argmax()) if hits.any() else -1, None
        if leader >= 0:
            its = ids[begin[leader]:begin[leader + 1]]
            its = its[df[its] > 1]
            more, less = np.setdiff1d(mine, its, True), np.setdiff1d(its, mine, True)
            if 4 * (len(more) + len(less)) <= len(mine):
                overlap = leaders[leader] + counted(more) - counted(less)
                led[x] = leader
        if overlap is None:
            overlap = leaders[x] = counted(mine)
            led[x] = x
        linked = np.flatnonzero(overlap[:x] * (PART + WHOLE) >= (n[:x] + n[x]) * PART)
        if side is not None:
            linked = linked[side[order[linked]] != side[order[x]]]
        if len(linked):
            yield int(order[x]), order[linked]


LINKS = "key binary, a long, b long, links long"


def tile_links(members: DataFrame) -> DataFrame:
    """Rows with ``links``: documents linked with class ``key`` in a tile; rows with (a, b): links that join its components."""

    def tile(at: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        # rows that repeat id and words give the same set again
        sides, reps, keys, copies, raw = zip(*{row[:3]: row for row in rows}.values())
        sets = [np.frombuffer(s, np.uint64) for s in raw]
        side = np.array(sides)
        links, root = np.zeros(len(sets), np.int64), list(range(len(sets)))
        copies = np.array(copies)
        edges = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, linked in join_tile(sets, None if within(at) else side):
            links[x] += copies[linked].sum()
            links[linked] += copies[x]
            for y in linked.tolist():
                u, v = top(x), top(y)
                if u != v:
                    root[u] = v
                    edges.append((reps[x], reps[y]))
        some = np.flatnonzero(links)
        if not len(some):
            return None
        blank = [None] * len(some)
        a, b = ([e[k] for e in edges] for k in (0, 1))
        none = [None] * len(edges)
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some] + none, pa.binary()), pa.array(blank + a, pa.int64()), pa.array(blank + b, pa.int64()),
                                           pa.array(links[some].tolist() + none, pa.int64())], ["key", "a", "b", "links"])

    rows = members.select(*TILE, "side", "rep", "key", "c", "shingles").repartition(*TILE).sortWithinPartitions(*TILE)
    return in_arrow(rows, lambda b: by_tile(b, tile), LINKS)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows it is linked with) of every row."""
    sketch = cut(sketches(docs, commonness(docs)))
    rows = cut(sketch.select("doc_id", "key", "n"))
    live = sketch.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    first = F.min(F.struct("doc_id", "n", "prefix", "rare", "hist")).alias("f")
    classes = cut(live.groupBy("key").agg(first, F.count(F.lit(1)).alias("c")).select("key", "c", F.col("f.doc_id").alias("rep"), "f.n", "f.prefix", "f.rare", "f.hist"))
    release(sketch)
    live = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    entries = cut(shared_entries(classes))
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    dealt = cut(tiles(meetings(entries, sizes), CHUNK, CHUNK_SHINGLES))
    close = cut(survivors(dealt, classes))
    links = cut(tile_links(close.join(sets_of(docs, cut(close.select("rep").distinct())), ["rep", "key"])))

    placed = cut(live.select("doc_id", "key").distinct().join(classes.select("key", "rep"), "key").select("doc_id", "rep"))
    low = placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).where("a < _z").drop("_z")
    repeated = placed.join(low, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    comps = components(links.where(F.col("a").isNotNull()).select("a", "b").unionByName(repeated))
    counts = links.where(F.col("links").isNotNull()).groupBy("key").agg(F.sum("links").alias("_l"))
    known = classes.select("key", "rep", "c").join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "key", "left")
    known = known.select("key", F.coalesce("component", "rep").alias("_c"), (F.coalesce("_l", F.lit(0)) + F.col("c") - 1).alias("_n"))
    out = rows.select("doc_id", "key", "n").join(known, "key", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("_c")).alias("component_id"),
                      F.when(alone, 0).otherwise(F.col("_n")).cast("long").alias("n_links"))
