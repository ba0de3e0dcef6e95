import re

import pytest

from dealsight.llm import mixing
from tests.llm.fixture_rows import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark):
    return [(i, prose(i, 5 + i % 40), ["b", "a", None, "é", "z"][i % 5] if i % 3 else "a") for i in range(100, 300)] + [(1, None, "only"), (2, "", "none")]


def targets(sizes):
    """Clamping one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    goal, held = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in held]
        level = (goal - sum(held.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return held | {s: level * weight[s] for s in rest}
        held |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_words_taken(spark):
    rows = rows_of(spark)
    docs = documents(spark, rows)
    got = mixing.mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = {}
    for d, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[d]
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in got)


def test_materialised_words_are_the_words_taken(spark):
    docs = documents(spark, rows_of(spark) + [(*r, "x") for r in awkward()])
    mixed = mixing.mix(docs)
    want = mixed.groupBy("row.source").sum("taken").collect()
    out = mixing.materialise(mixed)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    assert taken == {s: n for s, n in map(tuple, want) if n}


def test_whole_documents_are_near_the_target(spark):
    mixed = mixing.mix(documents(spark, rows_of(spark)))
    before = {r[0]: r[1] for r in mixed.groupBy("row.source").sum("taken").collect()}
    rows = mixing.whole_documents(mixed).select("row.source", "size", "taken").collect()
    assert all(r.taken % r.size == 0 for r in rows if r.size)
    for s, n in before.items():
        assert abs(sum(r.taken for r in rows if r.source == s) - n) <= max(r.size for r in rows if r.source == s) / 2


def test_equal_rows_share_the_rest(spark):
    rows = [(None, prose(1, 20), "a")] * 50 + [(7, prose(2, 10), "b")] * 3 + [(8, prose(2, 10), "c")]
    got = mixing.mix(documents(spark, rows)).select("row.source", "size", "source_size", "target", "taken").collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own) and all(r.taken <= 2 * r.size for r in own)


def test_first_words():
    assert mixing.first_words(b"  a\n b  c", 2) == b"  a\n b"


def test_empty_table(spark):
    docs = documents(spark, [])
    assert mixing.materialise(mixing.mix(docs)).count() == 0
