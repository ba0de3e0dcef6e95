import hashlib
import random

import numpy as np
import pytest

from dealsight.llm import suffix
from tests.llm.fixture_rows import awkward, documents, prose

L = suffix.LENGTH


def brute(rows):
    """Every window looked up among those of all smaller ids."""
    rows = [(suffix.LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    first = {}
    for k, _, b in rows:
        for p in range(len(b) - L + 1):
            w = b[p:p + L]
            first[w] = min(k, first.get(w, k))
    out = []
    for k, d, b in rows:
        mark = bytearray(len(b))
        for p in range(len(b) - L + 1):
            if first[b[p:p + L]] < k:
                mark[p:p + L] = b"\1" * L
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((d, len(b), sum(mark), sum(1 for x in bytes(mark).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    got = suffix.measure(documents(spark, rows).repartition(5)).collect()
    order = lambda r: (r[0] is None, *((x or 0) if not isinstance(x, str) else x for x in r))
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)


def passages(n=60):
    """Texts that share passages of many lengths, whole, overlapping, and split by an edit."""
    rng = random.Random(8)
    shared = [prose(900 + k, 40) for k in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(i, 20)]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 60)
            parts += [s[a:a + rng.randrange(30, 200)], prose(5000 + rng.randrange(30), rng.randrange(6))]
        rows.append((100 + i, "".join(parts)))
    return rows


def test_removed_bytes_equal_brute_force(spark):
    check(spark, awkward() + passages() + [(500, "a" * 400), (501, "b" + "a" * 300), (502, "ab" * 200), (503, "a" * 49), (504, "a" * 50), (504, "c" + "a" * 60)])


def test_hot_anchors_go_to_groups_by_content(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "FEW", 1)
    line = prose(77, 30)
    check(spark, passages(25) + [(1000 + i, f"{prose(i, 4)}{i}{line}{i}{prose(i + 50, 4)}") for i in range(40)])


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 700)
    long = prose(5, 900)
    check(spark, [(1, long), (2, "x" + long[100:3000] + "y" + long[2500:]), (3, long)])


def test_suffix_sort_orders_like_bytes_and_survives_equal_hashes(monkeypatch):
    rng = random.Random(4)
    items = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 70))) for _ in range(80)] * 2
    width = max(map(len, items))
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in items), np.uint8).reshape(-1, width)
    row, start = np.arange(len(items)), np.zeros(len(items), int)
    order = suffix.Suffixes(raw).sort(row, start, np.array([i % 3 for i in range(len(items))]))
    assert [(i % 3, items[i][:L]) for i in order] == sorted((i % 3, items[i][:L]) for i in range(len(items)))
    args = (np.zeros(len(items), np.int64), np.arange(len(items)), np.full(len(items), 19), items)
    want = [x.tolist() for x in suffix.covered_windows(*args)]
    assert [x.tolist() for x in suffix.covered_few(*args)] == want
    monkeypatch.setattr(suffix.Suffixes, "hashes", lambda self, row, start, length: np.zeros(len(row), np.uint64))  # all collide
    assert [x.tolist() for x in suffix.covered_windows(*args)] == want
    assert [x.tolist() for x in suffix.covered_few(*args)] == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "")], [(None, "z" * 80), (None, "z" * 80)]])
def test_small_tables(spark, rows):
    check(spark, rows)
