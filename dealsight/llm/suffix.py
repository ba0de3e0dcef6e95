"""Removal of repeated passages: every byte under a LENGTH-byte string that a document with a smaller id also holds.

Sampling.  Each window of LENGTH bytes names an anchor: of its K-byte strings the one with the smallest hash.  Equal
windows name equal anchors at equal places, so only windows that meet at an anchor hash can be equal.  Neighbouring
windows with one anchor form an entry: the bytes from the first window's start to the last one's end, about 65 bytes.

Whole entries.  Entries of one anchor hash whose polynomial hashes agree as well are equal; all but those of the smallest
document are covered in full, and no text moves for them.  That leaves anchors with several different entries, the ends of
repeated passages, and of each entry only the first document's.

Suffix sort.  These entries are sorted as suffixes, by mergesort: two suffixes are compared by binary search for their
common extension on prefix polynomial hashes, so a comparison takes about log2(LENGTH) steps.  In groups of FEW entries
the suffixes from the anchor are sorted, and neighbours' common extensions to the right, with those to the left, give what
two entries share.  In larger groups every window is sorted as a suffix, and equal ones form runs.  What the hashes call
equal is compared byte by byte; all but the smallest document's copy is covered.

An anchor with more than HOT different entries is not met in one task: its windows go to groups of their own by content.
Equal entries and windows are reduced to the smallest document inside each batch first, so what a third of all documents
share arrives once a batch.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; a null ``doc_id`` counts as the largest; rows
that repeat a ``doc_id`` are separate texts that do not affect each other; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import map_batches, texts

LENGTH, K = 50, 18
RUNS = LENGTH - K + 1  # K-byte strings in a window
BLOCK = 1 << 17  # bytes hashed at once: what is made of them stays in a cache
SHORT = 24  # bits of an anchor hash that are not shuffled with a sample, the upper ones, as those of small hashes say little; zeros take no room
HOT = 4096
FEW = 16  # entries of a group that are compared with each other rather than window by window
TASK_BYTES = 16 << 20  # text whose entries one task sorts
LAST = 2**63 - 1
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of the base and of its inverse modulo 2**64."""
    value = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return value, out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def first_smallest(h: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest value in every window of RUNS values, by doubling; values count without the low bits
    that a place takes, so that one minimum finds both."""
    low = U((1 << len(h).bit_length()) - 1)
    v, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while width < RUNS:
        step = min(width, RUNS - width)
        v = np.minimum(v[:-step], v[step:])
        width += step
    return (v & low).astype(np.int64)


def block_entries(raw: np.ndarray, valid: np.ndarray, known: tuple) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor place, anchor hash, entry hash) of the valid window starts of ``raw``."""
    value, power, inverse = known
    n = len(raw)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value[raw] * power[:n], out=prefix[1:])
    h = mixed((prefix[K:] - prefix[:-K]) * inverse[:n - K + 1])
    anchor = first_smallest(h)[valid]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)]
    lo = np.flatnonzero(new)
    first, last, at = valid[lo], valid[np.r_[lo[1:], len(valid)] - 1], anchor[lo]
    whole = (prefix[last + LENGTH] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64)
    return first, last, at, h[at].view(np.int64), mixed(whole).view(np.int64)


def entries(items: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (item, first, last, anchor, anchor hash, entry hash), by item and place; places are those in the item.

    Small items share a block.  A long item is cut into blocks by window starts, always at the same places.
    """
    known = tables(BLOCK + 2 * LENGTH)
    held: list[tuple[int, int, bytes]] = []  # item, place of its first window, bytes
    size = 0

    def flush() -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        lengths = np.array([len(b) for _, _, b in held])
        begin = np.cumsum(lengths) - lengths
        windows = lengths - LENGTH + 1
        valid = np.arange(windows.sum()) + np.repeat(begin - np.cumsum(windows) + windows, windows)
        first, last, at, h, whole = block_entries(raw, valid, known)
        part = np.searchsorted(begin, first, "right") - 1
        off = (np.array([shift for _, shift, _ in held]) - begin)[part]
        return np.array([item for item, _, _ in held])[part], first + off, last + off, at + off, h, whole

    for item, b in enumerate(items):
        for s in range(0, max(len(b) - LENGTH + 1, 0), BLOCK):
            part = b[s:s + BLOCK + LENGTH - 1]
            if held and size + len(part) > BLOCK + LENGTH:
                yield flush()
                held, size = [], 0
            held.append((item, s, part))
            size += len(part)
    if held:
        yield flush()


def sample_batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """Different entries of a batch: (h, whole, doc).  Those that the batch itself shows to be covered have a null h."""
    parts = [(item, h, whole) for item, _, _, _, h, whole in entries(texts(b))]
    if not parts:
        return None
    item, h, whole = (np.concatenate(x) for x in zip(*parts))
    h <<= SHORT
    doc = b.column("_d").to_numpy()[item]
    order = np.argsort(whole, kind="stable")
    hs, ws, ds = h[order], whole[order], doc[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]
    covered = np.zeros(len(h), bool)
    covered[order] = ds > np.minimum.reduceat(ds, np.flatnonzero(new))[np.cumsum(new) - 1]
    keep = np.zeros(len(h), bool)
    keep[order] = new | np.r_[True, ds[1:] != ds[:-1]]  # in the order of the texts, which packs better
    return pa.RecordBatch.from_arrays([pa.array(h[keep], mask=covered[keep]), pa.array(whole[keep]), pa.array(doc[keep])], ["h", "whole", "doc"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition by anchor hash: covered entries (kind 0) and, of anchors with different entries from different
    documents, each entry of its smallest document (kind 1, or 2 at a hot anchor)."""
    got = []
    for b in batches:
        null = b.column("h").is_null()
        done = b.filter(null)
        if done.num_rows:
            yield from by_document(done.column("doc").to_numpy(), done.column("whole").to_numpy(), np.zeros(done.num_rows, np.int8))
        rest = b.filter(pa.compute.invert(null))
        if rest.num_rows:
            got.append(tuple(rest.column(c).to_numpy() for c in ("h", "whole", "doc")))
    if not got:
        return
    h, whole, doc = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.lexsort((doc, whole, h))
    h, whole, doc = h[order], whole[order], doc[order]
    anchor, entry = np.r_[True, h[1:] != h[:-1]], np.r_[True, (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])]
    covered = doc > doc[np.flatnonzero(entry)][np.cumsum(entry) - 1]
    group, start = np.cumsum(anchor) - 1, np.flatnonzero(anchor)
    firsts = doc[np.maximum.accumulate(np.where(entry, np.arange(len(doc)), 0))]  # of each entry, its smallest document
    several = np.minimum.reduceat(firsts, start) < np.maximum.reduceat(firsts, start)
    hot = np.add.reduceat(entry.astype(np.int64), start) > HOT
    kind = np.where(covered, 0, np.where(several, np.where(hot, 2, 1), -1)[group]).astype(np.int8)
    yield from by_document(doc, whole, kind)


def by_document(doc: np.ndarray, whole: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each document: its entry hashes of kind 0, 1 and 2, packed."""
    order = np.lexsort((kind, doc))
    order = order[kind[order] >= 0]
    doc, whole, kind = doc[order], whole[order], kind[order]
    if not len(doc):
        return
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ends = [start + np.add.reduceat((kind <= k).astype(np.int64), start) for k in range(3)]
    data = whole.astype("<i8").tobytes()
    for s in range(0, len(start), 1 << 16):
        part = slice(s, s + (1 << 16))
        cols, lo = [pa.array(doc[start[part]])], start[part]
        for hi in ends:
            hi = hi[part]
            cols.append(pa.array([data[8 * x:8 * y] or None for x, y in zip(lo.tolist(), hi.tolist())], pa.binary()))
            lo = hi
        yield pa.RecordBatch.from_arrays(cols, ["doc", "done", "asked", "hot"])


def text_check(text: bytes) -> int:
    """Tells texts apart that share a ``doc_id``."""
    return xxhash.xxh32_intdigest(text) - 2**31


def packed_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    """Texts compressed, as they are shuffled whole."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([b.column("_d"), b.column("doc_id"), pa.array([pack.compress(t) for t in texts(b)], pa.binary())], ["_d", "doc_id", "packed"])


def unpacked(b: pa.RecordBatch) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in b.column("packed").to_pylist()]


def scattered(doc: int, place: int) -> int:
    """A shuffle key for rows that need no partner."""
    return xxhash.xxh3_64_intdigest(b"%d %d" % (doc, place)) - 2**63


def extract_batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """Rows (g, doc, text_hash, lo, anchor, hi, bytes): covered stretches have no bytes, entries to be sorted have theirs."""
    b = b.filter(b.column("done").is_valid())  # the others have no reply
    items, docs = unpacked(b), b.column("_d").to_numpy()
    found = list(entries(items))
    if not found:
        return None
    item, first, last, at, h, whole = (np.concatenate(x) for x in zip(*found))
    wanted = []
    for c in ("done", "asked", "hot"):
        lists = [b"".join(x) for x in b.column(c).to_pylist()]
        wanted.append((np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists]), np.frombuffer(b"".join(lists), "<i8")))
    names = np.unique(np.concatenate([x for _, x in wanted]))  # the wanted hashes, numbered
    named = np.searchsorted(names, whole).clip(max=max(len(names) - 1, 0))
    mine = np.flatnonzero(names[named] == whole) if len(names) else np.zeros(0, np.int64)
    pair = item[mine] * np.int64(len(names)) + named[mine]
    done, asked, split = (mine[np.isin(pair, k * np.int64(len(names)) + np.searchsorted(names, x))] for k, x in wanted)
    check = np.array([text_check(t) for t in items], np.int32)
    lo, hi, k = first[done], last[done] + LENGTH, item[done]
    starts = np.flatnonzero(np.r_[True, (lo[1:] > hi[:-1]) | (k[1:] != k[:-1])][:len(done)])
    ends = np.r_[starts[1:], len(done)][:len(starts)] - 1
    rows = [(scattered(doc, s), doc, th, s, 0, e, None) for doc, th, s, e in zip(docs[k[starts]].tolist(), check[k[starts]].tolist(), lo[starts].tolist(), hi[ends].tolist())]
    lo, hi, k = first[asked], last[asked] + LENGTH, item[asked]
    rows += [(g, doc, th, s, a - s, e, items[i][s:e]) for g, doc, th, s, a, e, i in zip(
        h[asked].tolist(), docs[k].tolist(), check[k].tolist(), lo.tolist(), at[asked].tolist(), hi.tolist(), k.tolist())]
    hot: list[tuple] = []
    for x in split.tolist():
        i = int(item[x])
        hot += [(int(docs[i]), int(check[i]), p, int(at[x]) - p, items[i][p:p + LENGTH]) for p in range(int(first[x]), int(last[x]) + 1)]
    low: dict[bytes, int] = {}
    for doc, _, _, _, w in hot:
        low[w] = min(doc, low.get(w, LAST))
    for doc, th, p, a, w in hot:
        if doc > low[w]:
            rows.append((scattered(doc, p), doc, th, p, 0, p + LENGTH, None))
        else:
            rows.append((xxhash.xxh3_64_intdigest(w) - 2**63, doc, th, p, a, p + LENGTH, w))
    if not rows:
        return None
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["g", "doc", "text_hash", "lo", "anchor", "hi", "bytes"])


class Suffixes:
    """Windows (row, start) of padded entries, compared through prefix hashes."""

    def __init__(self, raw: np.ndarray):
        value, power, self.inverse = tables(raw.shape[1] + 1)
        self.raw = raw
        self.prefix = np.zeros((raw.shape[0], raw.shape[1] + 1), np.uint64)
        np.cumsum(value[raw] * power[:raw.shape[1]], axis=1, out=self.prefix[:, 1:])

    def hashes(self, row: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[row, start + length] - self.prefix[row, start]) * self.inverse[start]

    def common(self, r1: np.ndarray, s1: np.ndarray, r2: np.ndarray, s2: np.ndarray) -> np.ndarray:
        """Length of the common extension, LENGTH at most, by binary search."""
        got = np.zeros(len(r1), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            t = np.flatnonzero(got + step <= LENGTH)
            g = got[t]
            same = self.hashes(r1[t], s1[t] + g, step) == self.hashes(r2[t], s2[t] + g, step)
            got[t[same]] += step
            step >>= 1
        return got

    def before(self, r1: np.ndarray, s1: np.ndarray, r2: np.ndarray, s2: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the first suffix sorts before the second; ``ties`` is the answer for equal ones."""
        n = self.common(r1, s1, r2, s2)
        out = np.full(len(n), ties)
        t = np.flatnonzero(n < LENGTH)
        out[t] = self.raw[r1[t], s1[t] + n[t]] < self.raw[r2[t], s2[t] + n[t]]
        return out

    def sort(self, row: np.ndarray, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order by bucket, then suffix: mergesort of all buckets at once, each element placed by binary search in the
        run that its own is merged with."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        size = np.diff(np.r_[head, len(b)])
        begin, end = np.repeat(head, size), np.repeat(head + size, size)
        place = np.arange(len(b)) - begin
        width = 1
        while width < size.max(initial=0):
            live = np.flatnonzero(end - begin > width)
            pair = begin[live] + place[live] // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, end[live])
            left = live < middle
            lo = np.where(left, middle, pair)
            hi = np.where(left, np.minimum(pair + 2 * width, end[live]), middle)
            base = lo.copy()
            for side in (True, False):
                e = np.flatnonzero(left == side)
                while True:
                    e = e[lo[e] < hi[e]]
                    if not len(e):
                        break
                    mid = (lo[e] + hi[e]) // 2
                    x, y = order[mid], order[live[e]]
                    # a left element goes before equal ones of the right run, a right element after those of the left
                    less = self.before(row[x], start[x], row[y], start[y], not side)
                    lo[e[less]], hi[e[~less]] = mid[less] + 1, mid[~less]
            target = np.where(left, live + (lo - base), pair + (lo - base) + (live - middle))
            moved = order.copy()
            moved[target] = order[live]
            order = moved
            width *= 2
        return order


def covered_few(g: np.ndarray, doc: np.ndarray, anchor: np.ndarray, items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first, last covered window) in groups of FEW entries at most.

    Entries are sorted as suffixes from their anchor; the common extension to the right of two of them is the smallest
    between neighbours from one to the other, the one to the left is searched for in the same way.
    """
    size = np.array([len(x) for x in items])
    width = int((anchor + LENGTH).max(initial=0).clip(min=size.max(initial=0)))
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in items), np.uint8).reshape(-1, width)
    suffixes = Suffixes(raw)
    order = suffixes.sort(np.arange(len(items)), anchor, g)
    x, y = order[:-1], order[1:]
    next_to = suffixes.common(x, anchor[x], y, anchor[y])
    first, last = np.full(len(items), LENGTH * 2), np.full(len(items), -1)
    at, right, d = np.arange(len(items)), np.full(len(items), LENGTH), 0
    while len(at):
        d += 1
        same = np.flatnonzero(at + d < len(items))
        at, right = at[same], right[same]
        same = np.flatnonzero(g[order[at]] == g[order[at + d]])
        at, right = at[same], np.minimum(right[same], next_to[at[same] + d - 1])
        i, j = order[at], order[at + d]
        reach = np.minimum(right, np.minimum(size[i] - anchor[i], size[j] - anchor[j]))
        most = np.minimum(anchor[i], anchor[j])
        p = np.flatnonzero((doc[i] != doc[j]) & (reach + most >= LENGTH))
        i, j, reach, most = i[p], j[p], reach[p], most[p]
        left = np.zeros(len(p), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            t = np.flatnonzero(left + step <= most)
            n = left[t] + step
            t = t[suffixes.hashes(i[t], anchor[i[t]] - n, n) == suffixes.hashes(j[t], anchor[j[t]] - n, n)]
            left[t] += step
            step >>= 1
        p = np.flatnonzero(reach + left >= LENGTH)
        i, j, reach, left = i[p], j[p], reach[p], left[p]
        for k, (a, b, n, m) in enumerate(zip(i.tolist(), j.tolist(), left.tolist(), reach.tolist())):
            s, e = int(anchor[a]), int(anchor[b])
            if items[a][s - n:s + m] != items[b][e - n:e + m]:  # two strings with one hash: compare the bytes themselves
                n = next((z for z in range(min(s, e)) if items[a][s - z - 1] != items[b][e - z - 1]), min(s, e))
                m = next((z for z in range(min(size[a] - s, size[b] - e)) if items[a][s + z] != items[b][e + z]), min(size[a] - s, size[b] - e))
                left[k], reach[k] = n, m
        later = np.where(doc[i] > doc[j], i, j)
        lo, hi = anchor[later] - left, anchor[later] + reach - LENGTH
        live = np.flatnonzero(lo <= hi)
        np.minimum.at(first, later[live], lo[live])
        np.maximum.at(last, later[live], hi[live])
    entry = np.flatnonzero(last >= 0)
    return entry, first[entry], last[entry]


def in_several(whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose hash is that of another document too: windows without are equal to none, and need no sorting."""
    order = np.argsort(whole)
    start = np.flatnonzero(np.r_[True, whole[order][1:] != whole[order][:-1]])
    d = doc[order]
    several = np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start)
    return np.sort(order[np.repeat(several, np.diff(np.r_[start, len(order)]))])


def covered_windows(g: np.ndarray, doc: np.ndarray, anchor: np.ndarray, items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first, last covered window) for the entries with a window that an entry of a smaller document holds too."""
    size = np.array([len(x) for x in items])
    width = int(size.max())
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in items), np.uint8).reshape(-1, width)
    count = size - LENGTH + 1
    row = np.repeat(np.arange(len(items)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    bucket = np.unique(g, return_inverse=True)[1][row] * np.int64(LENGTH) + (anchor[row] - start)
    suffixes = Suffixes(raw)
    kept = in_several(suffixes.hashes(row, start, LENGTH), doc[row])
    if not len(kept):
        return kept, kept, kept
    row, start, bucket = row[kept], start[kept], bucket[kept]
    order = suffixes.sort(row, start, bucket)
    x, y = order[:-1], order[1:]
    same = (bucket[x] == bucket[y]) & (suffixes.common(row[x], start[x], row[y], start[y]) == LENGTH)
    check = np.flatnonzero(same)
    for s in range(0, len(check), 1 << 14):
        c = check[s:s + (1 << 14)]
        a, b = (raw[row[o[c]][:, None], start[o[c]][:, None] + np.arange(LENGTH)] for o in (x, y))
        if (a != b).any():  # two strings with one hash: sort by the bytes themselves
            keys = [(int(bucket[i]), items[row[i]][start[i]:start[i] + LENGTH]) for i in range(len(row))]
            order = np.array(sorted(range(len(row)), key=keys.__getitem__))
            same = np.array([keys[p] == keys[q] for p, q in zip(order[:-1].tolist(), order[1:].tolist())], bool)
            break
    run = np.r_[0, np.cumsum(~same)]
    d = doc[row[order]]
    low = np.minimum.reduceat(d, np.flatnonzero(np.r_[True, ~same]))[run]
    hit = order[d > low]
    first, last = np.full(len(items), LENGTH * 2), np.full(len(items), -1)
    np.minimum.at(first, row[hit], start[hit])
    np.maximum.at(last, row[hit], start[hit])
    entry = np.flatnonzero(last >= 0)
    return entry, first[entry], last[entry]


def sort_suffixes(batches: Iterator[pa.RecordBatch], most: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Of a partition by group: covered stretches (doc, text_hash, lo, hi).  Groups are sorted some at a time.

    Windows of one entry overlap, as all hold its anchor, so the covered ones form a single stretch.
    """
    names, held = ["doc", "text_hash", "lo", "hi"], []
    for b in batches:
        null = b.column("bytes").is_null()
        yield b.filter(null).select(names)
        rest = b.filter(pa.compute.invert(null))
        if rest.num_rows:
            held.append(rest)
    if not held:
        return
    t = pa.Table.from_batches(held).sort_by("g").combine_chunks()
    g = t.column("g").to_numpy()
    ends = np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
    s = 0
    while s < len(g):
        e = int(ends[max(np.searchsorted(ends, s + most, "right") - 1, np.searchsorted(ends, s, "right"))])
        part = t.slice(s, e - s)
        doc, lo = part.column("doc").to_numpy(), part.column("lo").to_numpy()
        anchor, items = part.column("anchor").to_numpy(), part.column("bytes").to_pylist()
        few = np.unique(g[s:e], return_inverse=True, return_counts=True)
        few = few[2][few[1]] <= FEW
        for rows, search in ((np.flatnonzero(few), covered_few), (np.flatnonzero(~few), covered_windows)):
            if len(rows):
                entry, first, last = search(g[s:e][rows], doc[rows], anchor[rows], [items[k] for k in rows])
                entry = rows[entry]
                cols = [doc[entry], part.column("text_hash").to_numpy()[entry], lo[entry] + first, lo[entry] + last + LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        s = e


def spans_of(text: bytes, stretches: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal removed stretches of a text."""
    if not stretches:
        return []
    th = text_check(text)
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in stretches if x["text_hash"] == th):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated(docs: DataFrame) -> DataFrame:
    """(_d, doc_id, packed, stretches): every row, its text compressed, with what is to be removed as a list of structs."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    sampled = map_batches(rows.select("_d", "text"), sample_batch, "h long, whole long, doc long")
    key = F.coalesce("h", F.xxhash64("whole", "doc"))
    settled = sampled.repartition(tasks, key).mapInArrow(settle, "doc long, done binary, asked binary, hot binary")
    parts = settled.repartition(F.col("doc")).groupBy("doc")  # one row a document and task: nothing to combine before
    replies = parts.agg(*[F.collect_list(c).alias(c) for c in ("done", "asked", "hot")])
    packed = map_batches(rows, packed_batch, "_d long, doc_id long, packed binary")
    # both joins are left joins on the same columns, so the texts are shuffled once and that shuffle is read twice
    extracted = map_batches(packed.join(replies, F.col("_d") == F.col("doc"), "left").select("_d", "doc_id", "packed", "done", "asked", "hot"), extract_batch,
                            "g long, doc long, text_hash int, lo long, anchor long, hi long, bytes binary")
    found = extracted.repartition(tasks, "g").mapInArrow(sort_suffixes, "doc long, text_hash int, lo long, hi long")
    stretches = found.repartition(F.col("doc")).groupBy("doc").agg(F.collect_list(F.struct("text_hash", "lo", "hi")).alias("stretches"))
    return packed.join(stretches, F.col("_d") == F.col("doc"), "left").select("_d", "doc_id", "packed", "stretches")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes of every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, stretches in zip(unpacked(b), b.column("stretches").to_pylist()):
            spans = spans_of(text, stretches)
            digest, at = hashlib.sha256(), 0
            for lo, hi in spans:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            out.append((len(text), sum(hi - lo for lo, hi in spans), len(spans), digest.hexdigest()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, zip(*out))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(repeated(docs), batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
