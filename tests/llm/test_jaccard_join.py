import random

import numpy as np
import pytest

from dealsight.llm import jaccard
from tests.llm.fixture_rows import awkward, documents, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id, n_shingles, component_id and n_links of every row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] is None or rows[y][0] is None or not sets[x] or not sets[y]:
                continue
            both = len(sets[x] & sets[y])
            linked = 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both)
            links[x] += linked
            links[y] += linked
            if linked or rows[x][0] == rows[y][0]:
                root[top(x)] = top(y)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return [(d, len(sets[k]), least.get(top(k)) if d is not None else None, links[k]) for k, (d, _) in enumerate(rows)]


def variants(seed, base, n, edits, first):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append((first + k, " ".join(words)))
    return out


def collection():
    rows = awkward() + [(20, "A b C"), (21, "a B c"), (22, "a b c d"), (23, "one")]
    rows += variants(1, prose(50, 150), 70, 6, 100) + variants(2, prose(51, 400), 40, 18, 300) + variants(3, prose(52, 60), 40, 3, 400)
    line = prose(53, 30)
    rows += [(500 + k, f"{prose(600 + k, 6 + 5 * k)} {line}") for k in range(30)] + [(550 + k, line) for k in range(12)]
    rows += [(700 + k, prose(54, 100 + 4 * k)) for k in range(30)]  # a chain of growing texts
    rows += [(6, prose(54, 100)), (None, prose(54, 100)), (500, "something else that is not alike at all")]
    random.Random(4).shuffle(rows)
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=str)


def test_join_equals_brute_force(spark):
    rows = collection()
    assert result(jaccard.similar(documents(spark, rows))) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("chunk, common", [(3, 0), (16, 5)])
def test_chunks_and_common_shingles_change_nothing(spark, monkeypatch, chunk, common):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "commonness", lambda docs: np.resize(np.array([0, common, 0], np.uint8), jaccard.BUCKETS))
    rows = collection()
    assert result(jaccard.similar(documents(spark, rows))) == sorted(brute(rows), key=str)


def test_tile_finds_every_link_and_only_links(spark):
    rng = random.Random(9)
    for trial in range(30):
        pool = [rng.randrange(2**63) for _ in range(60)]
        base = rng.sample(pool, rng.randrange(5, 50))
        sets = []
        for _ in range(rng.randrange(2, 25)):
            s = set(base)
            for _ in range(rng.randrange(0, 9)):
                s ^= {rng.choice(pool)}
            if rng.random() < 0.3:
                s = set(rng.sample(pool, rng.randrange(1, 40)))
            sets.append(np.array(sorted(s or {1}), np.uint64))
        side = np.array([rng.randrange(2) for _ in sets]) if trial % 2 else None
        got = sorted(tuple(sorted((x, y))) for x, ys in jaccard.join_tile(sets, side) for y in ys.tolist())
        want = [(x, y) for y in range(len(sets)) for x in range(y) if (side is None or side[x] != side[y])
                and 180 * len(set(sets[x].tolist()) & set(sets[y].tolist())) >= 80 * (len(sets[x]) + len(sets[y]))]
        assert got == sorted(want)


def test_histograms_rule_out_no_link():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for trial in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        sets = [np.unique(np.r_[base[: int(len(base) * rng.uniform(0.6, 1)) + 1], rng.integers(0, 2**63, rng.integers(0, 1 + len(base) // 4), dtype=np.uint64)]) for _ in range(12)]
        sets += [np.unique(rng.integers(0, 2**63, len(base), dtype=np.uint64)) for _ in range(6)]
        side = rng.integers(0, 2, len(sets)) if trial % 2 else None
        hit = jaccard.may_link([jaccard.histogram(s).astype(np.int64) for s in sets], np.array([len(s) for s in sets]), side)
        linked = {k for x, ys in jaccard.join_tile(sets, side) for k in (x, *ys.tolist())}
        assert linked <= set(np.flatnonzero(hit).tolist())
        ruled_out += int((~hit).sum())
    assert ruled_out > 100


def test_variants_make_few_rows(spark):
    rows = variants(8, prose(60, 200), 300, 4, 0)
    docs = documents(spark, rows)
    sketch = jaccard.sketches(docs, jaccard.commonness(docs))
    assert sketch.count() == 300
    found = jaccard.similar(docs)
    assert found.select("component_id").distinct().count() < 20 and found.agg({"n_links": "max"}).first()[0] > 100


def test_empty_table(spark):
    assert jaccard.similar(documents(spark, [])).count() == 0
