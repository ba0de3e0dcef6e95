import random

import numpy as np

from dealsight.llm import suffix
from tests.llm.fixture_rows import prose

L, K = suffix.LENGTH, suffix.K


def test_windows_without_a_partner_are_not_sorted(monkeypatch):
    # every window of a large group was sorted, those of an anchor's unlike entries too
    rng = random.Random(3)
    anchor = bytes(rng.choice(b"abc") for _ in range(K))
    text = lambda n: bytes(rng.choice(b"xyz") for _ in range(n))
    items = [text(30) + anchor + text(30) for _ in range(30)]
    items += [items[4][:70] + text(8), items[9]]  # documents 30 and 31 repeat some of others
    sorted_windows = []
    whole = suffix.Suffixes.sort
    monkeypatch.setattr(suffix.Suffixes, "sort", lambda self, row, start, bucket: sorted_windows.append(len(row)) or whole(self, row, start, bucket))
    n = len(items)
    entry, first, last = suffix.covered_windows(np.zeros(n, np.int64), np.arange(n), np.full(n, 30), items)
    assert entry.tolist() == [30, 31] and first.tolist() == [0, 0] and last.tolist() == [20, 28]
    assert sum(sorted_windows) < 120 < sum(len(x) - L + 1 for x in items)
    assert not any(len(x) for x in suffix.covered_windows(np.zeros(4, np.int64), np.arange(4), np.full(4, 30), items[:4]))


def test_entries_come_by_block_with_places_in_their_item(monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 600)
    items = [b"", prose(1, 3).encode()[:49], prose(2, 30).encode(), prose(3, 300).encode(), prose(3, 300).encode()[7:], prose(4, 12).encode()]
    seen = {}
    for item, first, last, at, h, whole in suffix.entries(items):
        assert len({len(x) for x in (item, first, last, at, h, whole)}) == 1
        for i, f, z, a, x, w in zip(*(v.tolist() for v in (item, first, last, at, h, whole))):
            assert f <= a <= f + L - K and z <= a <= z + L - K  # every window holds the anchor
            assert seen.setdefault(w, (x, items[i][f:z + L])) == (x, items[i][f:z + L])
            assert seen.setdefault(("anchor", x), items[i][a:a + K]) == items[i][a:a + K]
            for p in range(f, z + 1):
                assert seen.setdefault((i, p), True) and seen.setdefault(("window", items[i][p:p + L]), a - p) == a - p
    assert sum(isinstance(k[0], int) for k in seen if isinstance(k, tuple)) == sum(max(len(x) - L + 1, 0) for x in items)
