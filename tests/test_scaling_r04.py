"""Whole jobs and plans of round 4."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dealsight.operators import matching as ma
from dealsight.plans import CATALOG


def test_cliff_query_matches_every_cliff(tables, monkeypatch):
    # the query summed counts of cliffs and no longer ran the operator that matches and ranks each of them
    rows = []

    def kept(*args, **kw):
        rows.append(whole(*args, **kw))
        return rows[-1]

    whole = ma.patent_cliff_matches
    monkeypatch.setattr(ma, "patent_cliff_matches", kept)
    got = CATALOG["patent_cliff_matches"].run(tables)
    assert len(rows) == 1 and "Limit" not in rows[0]._jdf.queryExecution().optimizedPlan().toString()
    cols = ["matches", "cliffs", "best_rank", "rank_sum", "cliff_urgency", "match_score"]
    every = whole(tables.companies.select("company_id", "areas"), tables.cliffs, tables.acquirers, tables.deals, "2001-12-01 00:00:00")
    every = every.groupBy("company_id", "acquirer_id").agg(F.count(F.lit(1)), F.count_distinct("cliff_id"), F.min("rank"), F.sum("rank"), F.round(F.max("cliff_urgency"), 6), F.max("match_score"))
    assert sorted(map(tuple, got.select("company_id", "acquirer_id", *cols).collect())) == sorted(map(tuple, every.collect()))


def test_cliff_ranks_of_large_groups_are_sliced(spark):
    # all rows of a set of areas were dealt by slices, so a buyer's matches were summed in as many tasks
    areas, now = ["a", "b"], datetime(2020, 1, 1)
    rows = [(k % 3, 1000 - k if k % 9 else k % 2, f"d{k % 4}", areas[k % 5 == 0], now + timedelta(days=(k % 17 == 0) * 500 + 10)) for k in range(200)] + [(1, None, "d", "a", now + timedelta(days=9))] * 2
    cliffs = spark.createDataFrame(rows, "acquirer_id long, cliff_id long, drug_name string, area string, expiry_date timestamp_ntz")
    targets = spark.createDataFrame([(1, ["b", "a"]), (2, ["a"]), (3, ["c"]), (4, None)], "company_id long, areas array<string>")
    buyers = spark.createDataFrame([(k, f"b{k}", "big_pharma", areas, 1.0, 1.0, 20.0, 0.0, True) for k in range(3)],
                                   "acquirer_id long, acquirer_name string, acquirer_type string, areas array<string>, cash double, debt double, market_cap double, recent_spend double, is_active boolean")
    deals = spark.createDataFrame([], "acquirer_id long, areas array<string>")
    got = ma.patent_cliff_matches(targets, cliffs, buyers, deals, "2020-01-01 00:00:00")
    low = lambda x: (x is not None, x if x is not None else 0)
    for company, wanted in ((1, areas), (2, ["a"])):
        mine = sorted(got.where(F.col("company_id") == company).collect(), key=lambda r: r["rank"])
        want = sorted((r for r in rows if r[3] in wanted), key=lambda r: (-(100 if r[4] < now + timedelta(days=365) else 90), low(r[1]), r[0], r[2], r[4]))
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert [(r.cliff_id, r.acquirer_id, r.drug_name, r.expiry_date) for r in mine] == [(r[1], r[0], r[2], r[4]) for r in want]
        for buyer in range(3):
            ids = {r[1] for r in want if r[0] == buyer and r[1] is not None}
            assert sum(r.is_first for r in mine if r.acquirer_id == buyer) == len(ids)
    assert got.where("company_id > 2").count() == 0


def test_cut_offs_of_a_backtest_are_not_dealt_by_step(spark):
    # a row for each deal and step was shuffled five times
    import datetime

    from dealsight.operators import validation as va

    start, when = datetime.date(2022, 1, 1), datetime.datetime(2022, 1, 1)
    deals = [(k, None if k == 11 else k % 3, None if k == 7 else when + timedelta(days=k % 5, hours=k)) for k in range(12)] + [(3, 1, when + timedelta(days=2))]  # 3 comes twice
    signals = [(k % 3 if k % 10 else None, when + timedelta(days=k % 40 - 30, hours=5)) for k in range(90)] + [(1, None)]
    scores = [(k % 3, start + timedelta(days=k * 3 % 50 - 40), float(k) if k % 4 else None) for k in range(60)] + [(None, start, 1.0), (2, None, 9.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = va.point_in_time_backtest(frame(deals, "deal_id int, company_id int, announced timestamp_ntz"), frame(signals, "company_id int, event_date timestamp_ntz"),
                                    frame(scores, "company_id int, score_date date, score double"), steps=4, profile_steps=(2, 9), step_days=3)
    assert got.columns == ["deal_id", "step", "company_id", "announced", "profile_step", "signals", "score", "scored_on"]
    want = []
    for a in deals:
        for b in (b for b in deals if b[0] == a[0]):
            for step in (1, 2, 3, 4, 9):
                day = b[2] and b[2].date() - timedelta(days=step * 3 + 1)
                known = [(d, -1.0 if x is None else x) for c, d, x in scores if day and c == b[1] and d and d <= day]
                n = sum(c == b[1] and (t is None or bool(day) and t.date() <= day) for c, t in signals)  # a signal without a date is known
                on, x = max(known, default=(None, None))
                want.append((a[0], step, a[1], a[2], step in (2, 9), n, None if x == -1.0 else x, on))
    low = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted(map(tuple, got.collect()), key=low) == sorted(want, key=low)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "deal_id" in x]
    assert plan.index("Generate") < plan.index("Join")  # steps are laid out after the last join


def test_targets_are_met_as_lists(spark, monkeypatch):
    # a join copied each of all rows of (target, buyer)
    targets = spark.createDataFrame([(1, ["a"], "a"), (2, ["a"], "a"), (3, None, ""), (2, ["a"], "a"), (None, None, "a")], "company_id long, areas array<string>, sig string")
    found = spark.createDataFrame([("a", 7, 1), ("a", 8, None), ("", 7, 3), ("b", 9, 4)], "sig string, acquirer_id long, rank long")
    want = sorted([(7, 1, c) for c in (0, 1, 2, 2)] + [(8, -1, c) for c in (0, 1, 2, 2)] + [(7, 3, 3)])
    for most, join in ((9, "BroadcastHashJoin"), (4, "Join")):
        monkeypatch.setattr(ma, "MANY_TARGETS", most)
        got = ma.for_targets(targets, found)
        assert got.columns == ["acquirer_id", "rank", "company_id", "areas"]
        assert sorted((r.acquirer_id, -1 if r["rank"] is None else r["rank"], r.company_id or 0) for r in got.collect()) == want
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert join in plan and ("Generate explode" in plan) == (most == 9)
