import numpy as np
import pytest

from dealsight.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, list int, v string, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7, "v", "r", "s") for i, v in rows], SCHEMA)


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    size = max(set(len(v) for _, v in ok), key=[len(v) for _, v in ok].count)
    ok = [(i, v) for i, v in ok if len(v) == size]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in ok if j != i))[:k]
    return out


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 2
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims))
    return [(i, (v * rng.uniform(0.2, 3)).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("dims", [5, 48])
def test_recall_scores_and_order(spark, dims):
    rows = clustered(1500, dims, 1)
    rows += [(5000 + k, rows[7][1]) for k in range(40)]  # equal vectors tie
    rows += [(6000, None), (6020, [0.0] * dims), (6040, [float("nan")] * dims), (6060, [None] * dims), (6080, [float("inf")] + [0.0] * (dims - 1)), (6100, [1.0] * (dims + 1)), (6120, [])]
    got = {}
    for r in neighbours.search(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == dims and None not in v}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert i != q and s == pytest.approx(float(vectors[q] @ vectors[i]), rel=1e-12, abs=1e-12)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * 20 * len(want)


def test_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rows = [(i, [1.0 + i % 7 * 1e-3, 0.5, float(i % 3)]) for i in range(600)]
    got = {}
    for r in neighbours.search(table(spark, rows), recall=1.0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q, want in brute(rows, 20, 20).items():
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [0.0, -1.0]), (3, [2.0, 0.0])]
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(table(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 1), (0, 3, 20), (20, 1, 0), (20, 2, 3), (20, 3, 1)]
    assert neighbours.search(table(spark, [])).count() == 0 == neighbours.search(table(spark, [(0, None)])).count()
    assert neighbours.search(table(spark, [(0, [1.0])])).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e4, 1e6])
def test_equal_scores_are_not_abandoned_at_any_size(size):
    rng = np.random.default_rng(4)
    k = 5
    for _ in range(60):
        x = rng.normal(size=(60, 96)) * size
        x[30:36] = x[7]
        q = rng.normal(size=(1, 96)) * size
        q[0] = x[7] + rng.normal(size=96) * size / 10
        d = ((q[:, None] - x[None]) ** 2).sum(2)
        bound = np.sort(d, 1)[:, k - 1]
        _, b = neighbours.scan(q, x, np.zeros((1, 60), bool), bound, k, 50.0)
        assert {7, *range(30, 36)} <= set(b.tolist())
