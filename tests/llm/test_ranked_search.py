import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dealsight.llm import ranked
from tests.llm.fixture_rows import awkward, documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_LETTERS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = "item_id long, text string, doc_id string, score string, rank string, items string"


def found(text):
    return TERM.findall((text or "").translate(SMALL_LETTERS))


def brute(docs, items, top=10):
    counts = [(d, Counter(found(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in set(items):
        rows = []
        for d, c, size in counts:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(found(text)) if w in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return out


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame([(*i, "x", "s", "r", "i") for i in items], ITEMS)


def collection():
    docs = awkward() + [(100 + k, prose(k, 5 + 7 * k, 300)) for k in range(60)] + [(200 + k, prose(7, 60)) for k in range(30)]
    docs += [(300, "Alpha ALPHA alpha beta"), (301, "alpha-beta, beta: Ångström"), (302, "don't stop"), (None, "alpha beta"), (300, "beta beta gamma")]
    items = [(1, "alpha BETA"), (2, prose(7, 60)), (3, None), (4, "..."), (5, "nowhere at all zzz"), (6, prose(99, 2000)), (None, "alpha"), (1, "alpha BETA"),
             (7, " ".join(f"w{k}" for k in range(400))), (8, "ångström")]
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = collection()
    got = rows_of(ranked.search(documents(spark, docs), items_of(spark, items)))
    assert got == sorted(brute(docs, items), key=str)


@pytest.mark.parametrize("name, value", [("GROUP", 8), ("ITEMS", 2), ("WIDE", 256), ("SMALL", 0), ("PIECE", 3)])
def test_bounds_of_sizes_do_not_change_the_result(spark, monkeypatch, name, value):
    monkeypatch.setattr(ranked, name, value)
    docs, items = collection()
    got = rows_of(ranked.search(documents(spark, docs), items_of(spark, items), 4))
    assert got == sorted(brute(docs, items, 4), key=str)


def test_no_bound_is_below_its_score(spark):
    docs, items = collection()
    slices = ranked.index(documents(spark, docs)).collect()
    block = ranked.Block([set(ranked.terms(t.encode())) for _, t in items if t])
    counts = [Counter(ranked.terms((t or "").encode())) for _, t in docs]
    counts = [c for c in counts if c]
    block.weigh({k: sum(w in c for c in counts) for k, w in enumerate(block.words)}, len(counts), sum(c.total() for c in counts))
    exact = defaultdict(list)
    for c in counts:
        m = 10 + (90 * c.total() * block.n) // block.total
        exact[c.total(), max(c.values())].append([sum(int(block.weights[t]) * ((10**9 * c[block.words[t]]) // (1000 * c[block.words[t]] + 8 * m)) for t in own) for own in block.items])
    seen = 0
    for r in slices:
        bounds = block.bounds(np.array(r.sizes), np.array(r.most), r.width, bytes(r.slices))
        for k, key in enumerate(zip(r.sizes, r.most)):
            seen += 1
            assert any((bounds[:, k] >= np.array(e)).all() for e in exact[key])
    assert seen == len(counts)


def test_empty_tables(spark):
    docs, items = collection()
    assert ranked.search(documents(spark, []), items_of(spark, items)).count() == 0
    assert ranked.search(documents(spark, [(1, None), (2, " ")]), items_of(spark, items)).count() == 0
    assert ranked.search(documents(spark, docs), items_of(spark, [])).count() == 0
