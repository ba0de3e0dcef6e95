"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram (one count per possible length) reaches the driver.  Multiplicative weights solve the program: prices
start at a length's size and fall by the factor ``exp(-eta * covered share)``; a knapsack by dynamic programming finds the
configuration of most value at these prices, which then covers its lengths by a step.  The fractional multiplicities are
rounded to whole ones within the demand; what is left goes, best-fit decreasing, into their room and further sequences.  Pieces
take their place by rank among those of equal length, so the work on the driver depends on the capacity, not on the data.

Defined cases: a null or empty text is the end id alone; longer documents are cut at the capacity; repeated rows are
packed once each; an empty table gives no rows; a null ``doc_id`` is carried along.
"""
from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsight.functions.scale import positions
from dealsight.llm.common import cut, map_batches, texts

WORDS_KEPT, PARTS_KEPT = 150_000, 300_000  # entries a worker keeps
ODD = tuple(map(chr, range(0x1C, 0x20)))  # str.split() cuts here, the tokenizer does not
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: with letters it makes tokens of its own
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: printed bytes stand for themselves, the others for the characters from 256 on.
ALPHABET = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(PRINTED))}


class WordIds:
    """Ids of whole texts, put together from the ids of their words, as white space has none.

    A word of Latin-1 letters with marks before and after it is three runs to the tokenizer, which goes straight to the
    merges for each; every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.known, self.parts = self.tokenizer.model, {}, {"": b""}

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, run: str) -> bytes:
        """Ids of one run of small letters or of marks."""
        got = self.parts.get(run)
        if got is None:
            if len(self.parts) >= PARTS_KEPT:
                self.parts = {"": b""}
            spelled = run if run.isascii() else "".join(map(ALPHABET.__getitem__, run.encode()))
            got = self.parts[run] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return got

    def word(self, word: str) -> bytes:
        body = word.strip(MARKS)
        if "<|" in word or (body and not (body.isalpha() and (body.isascii() or max(body) <= "\xff"))):
            return self.plain(word)
        head, _, tail = word.partition(body) if body else (word, "", "")
        return self.part(head) + self.part(body.lower()) + self.part(tail)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in ODD):
            return self.plain(text)
        words = text.split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known, new = {}, set(words)
        for w in new:
            self.known[w] = self.word(w)
        return b"".join(map(self.known.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """One encoder per worker process and file; it outlives a task."""
    kept = vars(sys).setdefault("_corpus_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder, docs_, rows = word_ids(path), b.column("doc_id").to_pylist(), []
        for doc, text in zip(docs_, texts(b)):
            ids = encoder.encode(text.decode("utf-8", "replace")) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), batch, schema)


def best_configuration(value: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack: how often each length is used in the configuration of most value."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        got = best[room - lengths[:n]] + value[:n]
        k = int(np.argmax(got))
        if got[k] > best[room - 1]:
            best[room], pick[room] = got[k], k
        else:
            best[room] = best[room - 1]
    out: dict[int, int] = {}
    room = capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        out[int(pick[room])] = out.get(int(pick[room]), 0) + 1
        room -= int(lengths[pick[room]])
    return out


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, eta: float = 4.0,
                   part: float = 0.5) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional solution by multiplicative weights: configuration as (index, copies) -> multiplicity.

    A round takes the configuration worth most, so often that it covers the ``part`` of one of its lengths, and lowers the
    prices of what it covers.  The multiplicities are scaled so that the mean covered share of the volume is 1.
    """
    covered, out = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        price = lengths * np.exp(-eta * (covered - covered.min()))
        used = best_configuration(price, lengths, capacity)
        step = part * min(demand[k] / n for k, n in used.items())
        for k, n in used.items():
            covered[k] += n * step / demand[k]
        key = tuple(sorted(used.items()))
        out[key] = out.get(key, 0.0) + step
    scale = np.average(covered, weights=lengths * demand)
    return {key: x / scale for key, x in out.items()}


def solve(histogram: dict[int, int], capacity: int, rounds: int = 400) -> list[tuple[dict[int, int], int]]:
    """Whole configurations (length -> copies, multiplicity) that hold exactly the demand of the histogram.

    Multiplicities are rounded; copies beyond the demand are left out, and their room goes to the final best fit.
    """
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    fractional = configurations(lengths, left.astype(float), capacity, rounds) if len(lengths) else {}
    for key, x in sorted(fractional.items(), key=lambda p: (-p[1], p[0])):
        m, used = int(x + 0.5), dict(key)
        while m > 0 and (used := {k: min(n, int(left[k])) for k, n in used.items() if left[k]}):
            times = min(m, *(int(left[k]) // n for k, n in used.items()))
            plan.append(({int(lengths[k]): n for k, n in used.items()}, times))
            for k, n in used.items():
                left[k] -= n * times
            m -= times
    return plan + best_fit({int(x): int(n) for x, n in zip(lengths, left) if n}, plan, capacity)


def best_fit(rest: dict[int, int], plan: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts.  Configurations of ``plan`` with room take part: they move from it to the result."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, used: dict[int, int], n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((used, n))

    for used, n in plan:
        put(capacity - sum(k * c for k, c in used.items()), used, n)
    plan.clear()
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(n, capacity // length)
                put(capacity - each * length, {length: each}, n // each)
                n %= each
                continue
            room = rooms[at]
            used, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            take = min(m, n)
            if m > take:
                put(room, used, m - take)
            put(room - length, used | {length: used.get(length, 0) + 1}, take)
            n -= take
    return [g for room in groups.values() for g in room]


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Places by length: the first rank that a configuration takes, its copies, the offset and the first sequence."""
    rows, taken, first = [], {}, 0
    for used, m in plan:
        at = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), n, at, first))
            taken[length] = taken.get(length, 0) + n * m
            at += n * length
        first += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "copies": table[:, 2], "offset": table[:, 3], "sequence": table[:, 4]}


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, rounds: int = 400) -> DataFrame:
    """Pieces with their sequence and offset.  The histogram has at most ``capacity`` rows, the places a bound of that order."""
    got = cut(pieces(docs, path, capacity, end_id, with_ids))
    histogram = {r[0]: r[1] for r in got.groupBy("length").count().collect()}
    ranked = positions(got, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    place, carried = slots(solve(histogram, capacity, rounds)), got.columns

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy() - 1
        at = np.searchsorted(place["key"], (length << 44) + rank, "right") - 1
        within = rank - place["rank"][at]
        copies = place["copies"][at]
        cols = [b.column(c) for c in carried]
        cols += [pa.array(place["sequence"][at] + within // copies), pa.array(place["offset"][at] + within % copies * length)]
        return pa.RecordBatch.from_arrays(cols, [*carried, "sequence_id", "offset"])

    return map_batches(ranked, batch, ", ".join(f"{c} {t}" for c, t in got.dtypes) + ", sequence_id long, offset long")
