"""Scale helpers against brute force, with one key holding a third of the rows."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dealsight.functions import scale

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(900):
        key = 1 if i % 3 == 0 else rnd.randint(2, 40)
        out.append((i, key, T0 + timedelta(minutes=rnd.randint(0, 20000)), rnd.randint(0, 100)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id int, key int, ts timestamp_ntz, v int").repartition(5)


def by_key(rows):
    g = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        g.setdefault(r[1], []).append(r)
    return g


def hour():
    return F.date_trunc("hour", F.col("ts").cast("timestamp"))


def test_positions(df, rows):
    got = {r.id: (r.position, r.n) for r in scale.positions(df, ["key"], [F.col("v"), F.col("id")], total="n").collect()}
    for part in by_key(rows).values():
        for i, r in enumerate(sorted(part, key=lambda r: (r[3], r[0]))):
            assert got[r[0]] == (i + 1, len(part))


def test_global_positions(df, rows):
    got = {r.id: r.position for r in scale.positions(df, [], [F.col("v").desc(), F.col("id")]).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[0])))}


def test_previous_running_and_max(df, rows):
    d = scale.previous_values(df, ["key"], hour(), ["ts", "id"], {"prev": "v"})
    d = scale.running_sum(d, ["key"], hour(), ["ts", "id"], F.col("v"), "cum")
    d = scale.running_max(d, ["key"], hour(), ["ts", "id"], {"top": "v"})
    got = {r.id: (r.prev, r.cum, r.top) for r in d.collect()}
    for part in by_key(rows).values():
        prev, cum, top = None, 0, None
        for r in part:
            cum += r[3]
            assert got[r[0]] == (prev, cum, top)
            prev, top = r[3], r[3] if top is None else max(top, r[3])


def test_latest_and_top(df, rows):
    got = {r.key: r.id for r in scale.latest_per_key(df, ["key"], ["ts", "id"]).collect()}
    assert got == {k: p[-1][0] for k, p in by_key(rows).items()}
    top = scale.top_per_key(df, ["key"], [F.col("v").desc(), F.col("id")], 2).collect()
    want = {(k, r[0]) for k, p in by_key(rows).items() for r in sorted(p, key=lambda r: (-r[3], r[0]))[:2]}
    assert {(r.key, r.id) for r in top} == want


def test_top_per_key_prunes_before_the_shuffle(df):
    plan = scale.top_per_key(df, ["key"], [F.col("v").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_quantiles(df, rows):
    import statistics

    q = {r.key: r for r in scale.exact_quantiles(df, ["key"], "v", "id", {"p25": 0.25, "p75": 0.75}, exclusive=("p25", "p75")).collect()}
    m = {r.key: r.med for r in scale.exact_quantiles(df, ["key"], "v", "id", {"med": 0.5}).collect()}
    for k, part in by_key(rows).items():
        vals = [r[3] for r in part]
        assert m[k] == pytest.approx(statistics.median(vals))
        if len(vals) > 1:
            want = statistics.quantiles(vals, n=4)
            assert (q[k].p25, q[k].p75) == pytest.approx((want[0], want[2]))


def test_exclusive_quantile_of_two_extrapolates(spark):
    d = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id int, v double")
    q = scale.exact_quantiles(d, [], "v", "id", {"p25": 0.25, "p75": 0.75}, exclusive=("p25", "p75")).first()
    assert (q.p25, q.p75) == (7.5, 22.5)


def test_reachable(spark):
    rows = [(k, p, p + 3 + (p % 2)) for k in (1, 2) for p in range(1, 200)]
    jumps = spark.createDataFrame([r for r in rows if r[2] < 200], "key int, pos int, next int")
    got = {(r.key, r.pos) for r in scale.reachable(jumps, ["key"], 1).collect()}
    want = set()
    for k in (1, 2):
        p = 1
        while p < 200:
            want.add((k, p))
            p = p + 3 + (p % 2)
    assert got == want


@pytest.mark.parametrize("whole", [500, 50_000])
def test_quantiles_by_bracket_equal_sorting(spark, monkeypatch, whole):
    monkeypatch.setattr(scale, "WHOLE_GROUP", whole)
    monkeypatch.setattr(scale, "SKETCH", 1000)
    monkeypatch.setattr(scale, "MARGIN", 0.01)
    rnd = random.Random(4)
    rows = [(None if i % 3 else "hot", float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1000])), i) for i in range(4000)] + [("one", 5.0, 9000), ("two", 1.0, 9001), ("two", 2.0, 9002), ("null", None, 9003)]
    df = spark.createDataFrame(rows, "key string, v double, id bigint")
    ps = {"p1": 0.01, "p25": 0.25, "med": 0.5, "p99": 0.99}
    got = {r.key: r for r in scale.exact_quantiles(df, ["key"], "v", "id", ps).collect()}
    assert set(got) == {None, "hot", "one", "two"}
    for key, r in got.items():
        vs = sorted(v for k, v, _ in rows if k == key and v is not None)
        assert r.n == len(vs)
        for name, q in ps.items():
            h = q * (len(vs) - 1)
            lo = int(h)
            want = vs[lo] + (h - lo) * (vs[min(lo + 1, len(vs) - 1)] - vs[lo])
            assert abs(r[name] - want) < 1e-6, (key, name)


def test_one_busy_hour_is_cut_into_even_slices(spark):
    """A key with a third of all rows, all in one hour: no slice of it holds twice the median."""
    import statistics

    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", T0 + timedelta(microseconds=i * 7) if i % 3 == 0 else T0 + timedelta(minutes=i), i, i % 11) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id bigint, v bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cut_up = scale.sliced(df, ["key"], ["ts", "id"])
        sizes = [r["count"] for r in cut_up.groupBy("_slice").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * statistics.median(sizes)
        got = {r.id: r.prev for r in scale.previous_values(cut_up, ["key"], F.col("_slice"), ["ts", "id"], {"prev": "v"}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    last = {}
    for key, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == last.get(key)
        last[key] = v
