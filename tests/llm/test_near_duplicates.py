import random

import numpy as np
import pytest

from dealsight.llm import graph, minhash, mixing, pii, rules
from tests.llm.fixture_rows import awkward, documents, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def group(base, n, most, seed):
    """A text and its variants, from close ones to ones beyond the limit."""
    text = prose(seed, 150, 3000)
    return [(base, text)] + [(base + i, edited(text, seed * 1000 + i, i % most)) for i in range(1, n)]


def check(spark, rows):
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_components_equal_brute_force(spark):
    rows = awkward() + group(100, 60, 14, 1) + group(300, 40, 9, 2) + [(500 + i, prose(50 + i, 100)) for i in range(40)]
    rows += [(600, "A b C d E f"), (601, "a B c D e F"), (602, "a b c d e f g"), (603, "Ä b c d e"), (604, "ä b c d e")]
    check(spark, rows)


def test_big_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    check(spark, group(100, 60, 14, 3))


def test_empty_table_and_texts_without_words(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    check(spark, [(1, None), (2, ""), (3, " ")])


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark):
    rows = awkward() + group(100, 30, 6, 4)
    docs = documents(spark, rows)
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((d is None, d or 0) for d in {*(d for d in want if want[d] == d), None})


def test_estimate_is_close_to_similarity():
    a, b = minhash._permutations()
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        common, extra = rng.integers(0, 2**64, 2000, dtype=np.uint64), rng.integers(0, 2**64, (2, int(2000 * (1 - share) / share / 2)), dtype=np.uint64)
        sig = [np.frombuffer(minhash.packed(minhash.minima(np.r_[common, e], a, b)), "<u8")[None] for e in extra]
        assert minhash.estimate(*sig)[0] == pytest.approx(share, abs=0.12)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 501), (501, 500), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 500: 500, 501: 500}


def test_one_id_with_several_texts_loses_none(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (1, b), (2, c), (3, b), (3, a + " w1"), (4, b.upper()), (2, c), (5, None), (5, "")]
    out = minhash.deduplicate(documents(spark, rows))
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(1, a), (1, b), (2, c), (5, "")])


def test_unlinked_variants_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 16)
    text = prose(9, 200, 3000)
    rows = [(k, edited(text, k, 18 if k % 7 else 3)) for k in range(120)]
    check(spark, rows)


def test_columns_of_any_name_and_kind(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, awkward() + group(100, 20, 6, 4)).withColumn("a.b", F.create_map(F.lit("k"), F.lit(1))).withColumn("c`d", F.lit(1))
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == minhash.deduplicate(docs.drop("a.b", "c`d")).count()
    mixed = mixing.mix(docs)
    assert mixing.materialise(mixed).columns == docs.columns and mixing.materialise(mixed).count() > 0
    assert pii.redact(docs, None).columns == docs.columns and pii.redact(docs, None).count() == docs.count()
    assert rules.keep(docs, rules.Rules(None, float("inf"))).columns == docs.columns and rules.keep(docs, rules.Rules(None, float("inf"))).count() > 0


def test_exact_ids_are_exact():
    found = [b"a b c d e f", b"A b c d e", b"a b", b"a b a b a b a b", b"", b"b a", b"a b"]
    owner, ids = minhash.exact_ids(found)
    sets = [frozenset(ids[owner == k].tolist()) for k in range(len(found))]
    want = [shingles(t.decode()) for t in found]
    for x in range(len(found)):
        for y in range(len(found)):
            assert len(sets[x] & sets[y]) == len(want[x] & want[y]) and len(sets[x]) == len(want[x])
