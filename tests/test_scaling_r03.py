"""Plans and results of queries that did not scale."""
import re

from dealsight.plans import CATALOG


def joins(df):
    """The joins of a plan before adaptive execution, outermost first."""
    return re.findall(r"(\w+Join) \[", df._jdf.queryExecution().sparkPlan().toString())


def test_steps_of_a_backtest_are_not_broadcast(tables):
    # a small file of deals is laid out by 24 steps, which the estimated size does not show
    assert joins(CATALOG["point_in_time_backtest"].run(tables))[0] == "SortMergeJoin"


def test_steps_of_a_rebuilt_backtest_are_not_broadcast(tables):
    # as above
    assert joins(CATALOG["backtest_rebuilt"].run(tables))[0] == "SortMergeJoin"


def test_revenue_metrics_keeps_no_years(tables):
    # years were rows that one task sorted by drug
    plan = CATALOG["revenue_metrics"].run(tables)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan.split("Subquery")[0]


def test_overlap_is_counted_between_sets_of_areas(spark):
    # Pairs of buyers and signatures were counted in one table a task, in as few tasks as the buyers filled
    from dealsight.operators import matching as ma

    buyers = spark.createDataFrame([(1, ["a", "b", "a"], "x"), (2, ["c"], "y"), (3, [], "z"), (4, None, "z"), (5, ["b", "a"], "w")],
                                   "acquirer_id long, areas array<string>, tag string")
    sig = spark.createDataFrame([("a,b", ["a", "b"], 2), ("b,c", ["b", "c"], 2), ("", [], 0)], "sig string, target_areas array<string>, target_size int")
    pairs = ma.overlapping(buyers, sig)
    assert sorted((r.acquirer_id, r.sig, r.both, r.tag) for r in pairs.collect()) == [
        (1, "a,b", 2, "x"), (1, "b,c", 1, "x"), (2, "b,c", 1, "y"), (5, "a,b", 2, "w"), (5, "b,c", 1, "w")]
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "HashAggregate" in line and "acquirer_id" in line]
    assert "xxhash64" in plan


def test_names_meet_at_what_deletions_leave(spark):
    # names that share a long prefix were candidates of every company
    from pyspark.sql import functions as F

    from dealsight.operators import events as ev

    row = spark.createDataFrame([("aab",), ("",)], "t string").select(F.array_sort(ev.shortened("t", 2)).alias("s")).collect()
    assert [r.s for r in row] == [["a", "aa", "aab", "ab", "b"], [""]]

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, old = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(old[j] + 1, line[-1] + 1, old[j - 1] + (x != y)))
        return line[-1]

    companies = {k: f"supplier {k:05d}" for k in range(40)}
    names = [f"{w} {k:05d}" for w in ("supplier", "supplir", "suplir", "splir", "nobody") for k in (*range(0, 60, 7), 111, 12345)]
    got = ev.entity_resolution(spark.createDataFrame([(x,) for x in names], "sponsor string"),
                               spark.createDataFrame(list(companies.items()), "company_id long, name string"))
    want = {}
    for x in names:
        d, k = min((edits(x, c), k) for k, c in companies.items())
        want[x] = (k, "exact" if d == 0 else "fuzzy") if d <= 2 else (None, "none")
    assert {r.sponsor: (r.company_id, r.how) for r in got.collect()} == want


def test_patents_of_a_span_are_not_laid_out_by_cut_off(spark):
    # every patent of a company met every cut-off
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from dealsight.operators import backtest as bt, components as co

    start, rows = datetime(2020, 1, 1), []
    for k in range(300):  # expiry from before the first cut-off to past the last band, some at the edges of bands
        days = (k * 23) if k % 3 else round((0, 3, 8, 15)[k % 4] * 365.25) + k % 70
        rows.append((k % 4, k, start + timedelta(days=days, hours=k % 2 * 5), k % 5 == 0, k % 2 == 0, k % 3 == 0, k % 20, k % 9))
    rows += [(5, 900, None, True, False, False, 3, 3)]
    patents = spark.createDataFrame(rows, "company_id long, patent_id long, expiry_date timestamp_ntz, is_composition boolean, is_method boolean,"
                                          " is_formulation boolean, claims_count int, citations_count int")
    days = [(c, start.date() + timedelta(days=d)) for c in range(6) for d in (0, 1, 2, 17, 31, 40, 69, 70, 400)]
    cuts = spark.createDataFrame(days, "company_id long, day date")
    end = F.date_add("day", 1).cast("timestamp_ntz")
    key = F.struct("company_id", "day")
    want = co.patent_component(cuts.withColumn("_end", end).join(patents, "company_id").withColumn("company_id", key), F.col("_end"))
    got = bt.patent_rows(patents, cuts, end)
    line = lambda df: sorted((r.company_id.company_id, r.company_id.day, round(r.score, 9), r.signals) for r in df.collect())
    assert line(got) == line(want) and len(line(got)) > 30


def test_cliff_ranks_are_counted_by_signature(spark):
    # every (target, cliff) row was sorted and then summed; ties, cliffs listed twice and targets alike
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from dealsight.operators import matching as ma

    areas = ["a", "b", "c"]
    targets = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["c"]), (4, None), (5, ["a", "b", "c"])], "company_id long, areas array<string>")
    now = datetime(2020, 1, 1)
    cliffs = [(k % 7, k // 2 if k % 10 else None, f"d{k % 3}", areas[k % 3], now + timedelta(days=k % 5 * 500 - 100)) for k in range(150)]
    cliffs += [(2, 900, "x", "a", now + timedelta(days=40)), (2, 900, "x", "b", now + timedelta(days=40)), (3, 900, "x", "b", now + timedelta(days=40))]
    cliffs = spark.createDataFrame(cliffs, "acquirer_id long, cliff_id long, drug_name string, area string, expiry_date timestamp_ntz")
    buyers = spark.createDataFrame([(k, f"b{k}", "big_pharma", areas[:k % 4], 10.0 * (k % 2), 1.0, 20.0, 0.0, True) for k in range(6)],
                                   "acquirer_id long, acquirer_name string, acquirer_type string, areas array<string>, cash double, debt double,"
                                   " market_cap double, recent_spend double, is_active boolean")
    deals = spark.createDataFrame([(k % 4, [areas[k % 3]]) for k in range(9)], "acquirer_id long, areas array<string>")
    args = (targets, cliffs, buyers, deals, "2020-01-01 00:00:00")
    every = ma.patent_cliff_matches(*args).groupBy("company_id", "acquirer_id").agg(
        F.count(F.lit(1)), F.count_distinct("cliff_id"), F.min("rank"), F.sum("rank"), F.max("cliff_urgency"), F.max("match_score"))
    got = ma.cliff_match_summary(*args)
    cols = ["company_id", "acquirer_id", "matches", "cliffs", "best_rank", "rank_sum", "cliff_urgency", "match_score"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, every.collect()))
    assert got.count() > 10 and not [x for x in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "company_id" in x and "Aggregate" in x]


def test_gap_points_are_summed_inside_a_row(spark):
    # a row a (signature, buyer, area) was joined and summed, and pairs met their targets by a merge on few signatures
    from dealsight.operators import matching as ma

    targets = spark.createDataFrame([(1, ["oncology", "neuro-oncology"], "phase_2", 10.0), (2, ["neuro-oncology", "oncology"], "phase_3", 6000.0),
                                     (3, None, "approved", None), (4, ["metabolic"], None, 700.0)], "company_id int, areas array<string>, stage string, peak_sales_mm double")
    gaps = spark.createDataFrame([(1, "ONC", "critical"), (1, "neuro", "high"), (2, "metabolic", "moderate"), (2, "metabolic", "high"), (3, None, "high"), (9, "oncology", "high")],
                                 "acquirer_id int, area string, severity string")
    buyers = spark.createDataFrame([(1, ["onc"]), (2, []), (3, None), (4, ["tab", "onc"])], "acquirer_id int, priorities array<string>")
    found = ma.gap_target_fit(targets, gaps, buyers)
    got = {(r.company_id, r.acquirer_id): (r.pair_points, r["rank"], r.fit) for r in found.collect()}
    points = {1: {1: 125, 4: 20}, 2: {1: 125, 4: 20}, 3: {}, 4: {2: 40, 4: 10}}  # 2 x 40 + 25 + 2 x 10; nothing for a buyer that is not listed
    own = {1: 12, 2: 40, 3: 0, 4: 15}
    want = {}
    for c, has in points.items():
        for k, b in enumerate(sorted(range(1, 5), key=lambda b: (-has.get(b, 0), b))):
            want[c, b] = (has.get(b, 0), k + 1, float(min(100, has.get(b, 0) + own[c])))
    assert got == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert joins(found)[0] == "BroadcastHashJoin" and not [x for x in plan.splitlines() if "HashAggregate(keys=[sig" in x and "acquirer_id" in x]


def test_near_duplicates_send_shared_shingles_only(spark):
    # all shingles were shuffled and written several times; texts of line breaks alone were one group
    import random

    from pyspark.sql import functions as F

    from dealsight.operators import events as ev

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice((3, 30, 60)))) for _ in range(25)]
    for t in texts[:]:
        words = t.split()
        for _ in range(2):
            words[rng.randrange(len(words))] = "new"
            texts.append(" \n".join(words).upper())
    texts += ["\n", "\t\n", " ", "", None, "one", "ONE ", "one two", texts[3] + " common line of six words", texts[8] + " common line of six words"]
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    comp = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = sorted((comp[a], comp[b]), reverse=True)
                comp = {k: new if v == old else v for k, v in comp.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.component for r in ev.near_duplicates(docs).collect()} == comp and len(set(comp.values())) < 70
    hashed = docs.select(F.col("doc_id").alias("doc"), ev.shingle_set(ev.word_list("text")).alias("hs")).select("doc", F.size("hs").alias("n"), "hs")
    assert {r.doc: r.n for r in hashed.filter("hs IS NOT NULL").collect()} == {k: len(x) for k, x in sets.items() if x}
    held = {k: sum(any(s in sets[o] for o in sets if o != k) for s in x) for k, x in sets.items()}
    got = {r.doc: len(r.hs) for r in ev.shared_sets(hashed, 75).collect()}
    assert got == {k: n for k, n in held.items() if n and 100 * n >= 75 * len(sets[k])} and len(got) < len(texts)
