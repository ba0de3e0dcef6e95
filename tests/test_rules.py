"""Band edges, golden watch list, valuation invariants and extension points."""
import pytest
from pyspark.sql import functions as F

from dealsight.functions import bands, clock
from dealsight.operators import components as co, history as hi, matching as ma, risk as ri, targets as tg, valuation as va

NOW = "2025-01-01 00:00:00"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("x,want", [(2.99, 100), (3, 90), (5.99, 90), (6, 80), (12, 60), (18, 40), (24, 20), (None, 20)])
def test_below_edges(spark, x, want):
    assert one(spark, bands.below(F.lit(x).cast("double"), co.RUNWAY_BAND, 20)) == want


def test_band_text_matches_column(spark):
    import duckdb

    for x in (0, 19.9, 20, 50, 99.9, 100, 250):
        text = bands.sql_at_least(str(x), ma.LIKELIHOOD, 0.05)
        assert float(duckdb.sql(f"SELECT {text}").fetchall()[0][0]) == one(spark, bands.at_least(F.lit(float(x)), ma.LIKELIHOOD, 0.05))


@pytest.mark.parametrize("a,b,want", [("2025-01-01 00:00:00", "2025-01-02 23:59:59", 1), ("2025-01-02 00:00:01", "2025-01-01 00:00:00", -2), ("2025-01-02 00:00:00", "2025-01-01 00:00:00", -1)])
def test_whole_days_floors(spark, a, b, want):
    assert one(spark, clock.whole_days(clock.at(a), clock.at(b))) == want


@pytest.mark.parametrize("days,want", [(6, 1.5), (7, 2 ** (-7 / 30)), (30, 0.5), (365, 0.1), (-3, 1.5)])
def test_decay(spark, days, want):
    assert one(spark, clock.decay_weight(F.lit(days))) == pytest.approx(want)


def test_tidy_rounds_exact_ties_up(spark):
    assert one(spark, bands.tidy(F.lit(0.3) * F.lit(85.35))) == 25.61


def test_two_patents_keep_the_unnormalised_weights(spark):
    d = spark.createDataFrame([(1, 100.0), (1, 100.0), (2, 80.0)], "company_id int, s double")
    got = {r.company_id: r.base for r in co.weighted_top(d, "company_id", "s", co.PATENT_TOP_WEIGHTS).collect()}
    assert got == {1: pytest.approx(80.0), 2: 80.0}


def test_weights_drop_disabled_and_reject_zero(spark):
    w = spark.createDataFrame([("a", 0.3, True), ("b", 0.1, True), ("c", 0.6, False)], "component string, weight double, enabled boolean")
    got = {r.component: r.weight for r in co.normalize_weights(w).collect()}
    assert got == {"a": pytest.approx(0.75), "b": pytest.approx(0.25)}
    zero = spark.createDataFrame([("a", 0.0, True)], "component string, weight double, enabled boolean")
    with pytest.raises(Exception):
        co.normalize_weights(zero).collect()


def test_ranking_weights_must_total_one(spark):
    with pytest.raises(ValueError):
        tg.rank_targets(spark.range(1), {"pipeline_quality": 0.5})


# fixed values: published sample universe and its published scores
UNIVERSE = [  # ticker, cap, cash, quarterly burn, stage, areas, assets, 52-week return, held, activist
    ("GPCR", 3200e6, 450e6, 45e6, "Phase 2", ["obesity_glp1"], 2, -15.0, 0.75, False),
    ("VKTX", 6800e6, 850e6, 35e6, "Phase 2", ["obesity_glp1"], 3, 320.0, 0.62, False),
    ("ALT", 950e6, 180e6, 25e6, "Phase 2", ["obesity_glp1"], 2, 45.0, 0.58, False),
    ("ELEV", 620e6, 125e6, 18e6, "Phase 2", ["oncology_adc"], 2, -35.0, 0.68, False),
    ("CMPX", 480e6, 95e6, 15e6, "Phase 2", ["oncology_adc"], 3, -42.0, 0.55, False),
    ("FUSN", 850e6, 165e6, 22e6, "Phase 2", ["radiopharmaceuticals"], 4, -18.0, 0.72, False),
    ("AURA", 725e6, 140e6, 20e6, "Phase 3", ["radiopharmaceuticals", "rare_disease"], 2, -28.0, 0.65, False),
    ("ANNX", 890e6, 180e6, 28e6, "Phase 3", ["autoimmune"], 3, -52.0, 0.70, False),
    ("XNCR", 1450e6, 285e6, 32e6, "Phase 2", ["autoimmune", "oncology_adc"], 8, -38.0, 0.82, False),
    ("PRAX", 1280e6, 240e6, 35e6, "Phase 3", ["cns_neuropsychiatry"], 4, -45.0, 0.75, False),
    ("SAGE", 1650e6, 520e6, 95e6, "Approved", ["cns_neuropsychiatry"], 3, -72.0, 0.88, True),
    ("TBPH", 580e6, 85e6, 18e6, "Phase 3", ["rare_disease"], 2, -48.0, 0.45, False),
    ("KRYS", 4800e6, 520e6, 42e6, "Approved", ["rare_disease", "gene_therapy"], 5, 55.0, 0.82, False),
    ("IMCR", 2350e6, 310e6, 38e6, "Approved", ["immunology", "oncology_adc"], 6, 85.0, 0.78, False),
    ("BLUE", 780e6, 145e6, 55e6, "Approved", ["gene_therapy", "rare_disease"], 3, -68.0, 0.52, True),
    ("RVMD", 7200e6, 1100e6, 85e6, "Phase 2", ["oncology_adc"], 4, 120.0, 0.85, False),
    ("REPL", 1150e6, 220e6, 32e6, "Phase 3", ["oncology_adc", "immunology"], 3, -22.0, 0.72, False),
    ("AKRO", 2450e6, 380e6, 48e6, "Phase 3", ["cardiovascular"], 2, 42.0, 0.80, False),
    ("RLAY", 1850e6, 410e6, 55e6, "Phase 2", ["oncology_adc"], 5, -42.0, 0.78, False),
    ("IGMS", 680e6, 165e6, 35e6, "Phase 2", ["oncology_adc", "immunology"], 4, -58.0, 0.65, False),
]
GOLDEN = [("REPL", 69.15, 0.49575), ("PRAX", 68.0, 0.59), ("RLAY", 67.3, 0.5865), ("ANNX", 67.25, 0.58625), ("AURA", 66.8, 0.484), ("IGMS", 66.75, 0.63375),
          ("FUSN", 66.3, 0.4815), ("TBPH", 66.0, 0.63), ("XNCR", 64.8, 0.374), ("ELEV", 64.75, 0.47375), ("SAGE", 64.5, 0.7225), ("GPCR", 64.2, 0.371),
          ("ALT", 64.15, 0.47075), ("IMCR", 60.9, 0.3545), ("RVMD", 60.5, 0.3025), ("VKTX", 58.8, 0.294), ("KRYS", 57.55, 0.28775)]


@pytest.fixture(scope="module")
def universe(spark):
    cols = "ticker string, market_cap double, cash_position double, quarterly_burn_rate double, lead_asset_phase string, therapeutic_areas array<string>, total_assets int, stock_return_52w double, institutional_ownership double, has_activist_investor boolean"
    d = spark.createDataFrame(UNIVERSE, cols)
    return (d.withColumn("name", F.col("ticker")).withColumn("company_id", F.monotonically_increasing_id()).withColumn("lead_asset", F.lit("lead"))
            .withColumn("lead_rank", bands.lookup(F.col("lead_asset_phase"), tg.PHASE_RANK, 0)).withColumn("region", F.lit("North America"))
            .withColumn("is_royalty", F.lit(False)).withColumn("is_platform", F.lit(False)).withColumn("ipo_date", F.lit(None).cast("timestamp"))
            .withColumn("has_takeover_rumors", F.lit(False)))


def test_golden_watchlist(universe):
    got = tg.identify_targets(universe, NOW, top_n=None).orderBy("rank").collect()
    assert [r.ticker for r in got] == [g[0] for g in GOLDEN]
    for r, (_, score, p) in zip(got, GOLDEN):
        assert r.composite == pytest.approx(score, abs=1e-9) and r.probability_12mo == pytest.approx(p, abs=1e-9)


def test_golden_statistics_and_gates(universe):
    d = tg.identify_targets(universe, NOW, top_n=None).withColumn("area", F.col("therapeutic_areas")[0])
    s = tg.watchlist_statistics(d).first()
    assert (s.targets, s.high_probability) == (17, 11)
    assert s.avg_score == pytest.approx(64.5706, abs=1e-4) and s.avg_probability == pytest.approx(0.478735, abs=1e-6) and s.total_value == pytest.approx(55_537_500_000)
    gates = {r.ticker: r.failed_gate for r in tg.screen(universe, NOW).filter("NOT passed").collect()}
    assert gates == {"CMPX": "market_cap", "BLUE": "finance", "AKRO": "strategy"}


def test_target_order_does_not_change_results(universe):
    a = {r.ticker: r["rank"] for r in tg.identify_targets(universe.repartition(7), NOW, top_n=None).collect()}
    assert a == {t: i + 1 for i, (t, _, _) in enumerate(GOLDEN)}


# ---- valuation --------------------------------------------------------------------

@pytest.fixture(scope="module")
def drug(spark):
    return spark.createDataFrame([(1, 1, "TEST-001", 2e9, "Phase 2", "Obesity/Metabolic", "standard", 3, 12, "competitive")],
                                 "drug_id int, company_id int, drug_name string, peak_sales double, phase string, area string, curve string, years_to_launch int, patent_life int, position string")


def test_valuation_invariants(drug):
    r = va.dcf_npv(drug).first()
    assert r.npv_risk_adjusted == pytest.approx(r.npv_unadjusted * r.probability) and r.probability == pytest.approx(0.27)
    s = {x.scenario: x.npv_risk_adjusted for x in va.scenarios(drug).collect()}
    assert s["bear"] < s["base"] < s["bull"] and s["base"] == pytest.approx(r.npv_risk_adjusted)


def test_revenue_curve(drug):
    rev = [x.revenue for x in va.revenue_projection(drug).orderBy("year").collect()]
    assert rev[:3] == [0, 0, 0] and rev[3] == pytest.approx(2e9 * 0.0474, rel=1e-2)
    assert all(a <= b for a, b in zip(rev[3:8], rev[4:9])) and max(rev) == 2e9
    assert rev[15] == pytest.approx(2e9 * 0.3) and rev[16] == pytest.approx(2e9 * 0.3 * 0.9) and rev[19] == pytest.approx(2e9 * 0.3 * 0.9 ** 3)


def test_time_to_peak_axis_is_flat(drug):
    rows = va.sensitivity_grid(drug).collect()
    flat = {round(r.npv_unadjusted, 4) for r in rows if r.variable == "time_to_peak"}
    assert len(flat) == 1
    peaks = [r.npv_unadjusted for r in sorted(rows, key=lambda r: r.setting) if r.variable == "peak_sales"]
    assert peaks == sorted(peaks)


def test_portfolio_is_the_sum_of_parts(spark, drug):
    d = drug.unionByName(drug.withColumn("drug_id", F.lit(2)).withColumn("peak_sales", F.lit(1e9)))
    v = va.dcf_npv(d)
    caps = spark.createDataFrame([(1, 1e9)], "company_id int, market_cap double")
    p = va.portfolio_valuation(v, caps).first()
    assert p.total_value == pytest.approx(sum(r.npv_risk_adjusted for r in v.collect())) and p.adjusted_value > p.total_value


# ---- matching --------------------------------------------------------------------------

def test_matching_equals_all_pairs(tables):
    """Signature matching against every (target, buyer) pair scored directly, for both score floors."""
    c, a, d = tables.companies.select("company_id", "areas"), tables.acquirers, tables.deals
    deals = {}
    for r in d.collect():
        deals.setdefault(r.acquirer_id, []).append(set(r.areas))
    buyers = a.filter("is_active").withColumn("cap", ma.capacity_score()).collect()
    for floor in (40.0, 20.0):
        got = {}
        for r in ma.match_acquirers(c, a, d, 3, floor).collect():
            got.setdefault(r.company_id, []).append((r["rank"], r.acquirer_id, r.match_score))
        for t in c.collect():
            ta, scored = set(t.areas or []), []
            for b in buyers:
                ba = set(b.areas or [])
                al = round(min(len(ta & ba) / len(ta) * 60 + 15 + min(len(ta - ba) * 5, 10), 100), 2) if ta and ba else 0.0
                h = min(10 * min(sum(1 for x in deals.get(b.acquirer_id, []) if x & ta), 10), 30)
                s = al * 0.35 + b.cap * 0.2 + h * 0.15 + ma.TYPE_ACTIVITY[b.acquirer_type] * 5
                if s >= floor:
                    scored.append((-round(s, 6), b.acquirer_id))
            want = [x[1] for x in sorted(scored)[:3]]
            mine = [x[1] for x in sorted(got.get(t.company_id, []))]
            assert len(mine) == len(want)
            assert [round(-dict((y, x) for x, y in scored)[m], 2) for m in mine] == pytest.approx([round(-x[0], 2) for x in sorted(scored)[:3]], abs=0.011)


def test_class_rank_is_percent_rank(tables):
    from pyspark.sql import Window as W

    d = ri.rank_in_class(ri.clinical_differentiation(tables.clinical))
    bad = d.withColumn("p", F.percent_rank().over(W.partitionBy("drug_class").orderBy("differentiation"))).filter(F.abs(F.col("p") - F.col("class_rank")) > 1e-9)
    assert bad.count() == 0


def test_strict_safety_bands(spark, tables):
    loose = ri.clinical_differentiation(tables.clinical).agg(F.sum("safety_score")).first()[0]
    assert ri.clinical_differentiation(tables.clinical, strict=True).agg(F.sum("safety_score")).first()[0] < loose


def test_percentile_of_a_lone_score(spark):
    d = spark.createDataFrame([(1, "2024-01-01", 10.0), (2, "2024-01-02", 5.0), (3, "2024-01-02", 5.0)], "company_id int, score_date string, score double")
    d = d.withColumn("score_date", F.col("score_date").cast("date"))
    assert {r.company_id: r.percentile for r in hi.percentile_ranks(d).collect()} == {1: 50.0, 2: 0.0, 3: 100.0}


# ---- extension points -----------------------------------------------------------------------

def test_custom_weights_change_the_composite(spark):
    long = spark.createDataFrame([(1, "a", 80.0, 5, None), (1, "b", 20.0, 5, None)], "company_id int, component string, score double, signals bigint, last_updated timestamp_ntz")
    w = lambda a, b: spark.createDataFrame([("a", a, True), ("b", b, True)], "component string, weight double, enabled boolean")
    assert co.composite_score(long, w(1.0, 1.0), NOW).first().overall_score == 50.0
    assert co.composite_score(long, w(3.0, 1.0), NOW).first().overall_score == 65.0


def test_registered_source_transform(spark):
    from dealsight.sources import normalize as no

    no.register_transform("upper", lambda d: d.withColumn("x", F.upper("x")))
    assert spark.createDataFrame([("a",)], "x string").transform(no.TRANSFORMS["upper"]).first().x == "A"


def test_handler_hook_on_a_stream(spark):
    import tempfile

    from dealsight.streaming import events as st

    src, seen = tempfile.mkdtemp(prefix="run-"), {}
    spark.createDataFrame([("signals.a",), ("signals.b",), ("other",)], "topic string").coalesce(1).write.mode("append").parquet(src)
    q = st.route_stream(st.read_events(spark, src, "topic string"), {"s": lambda d: seen.__setitem__("s", d.count())}, {"s": "signals.*"}, tempfile.mkdtemp(prefix="run-"))
    q.awaitTermination()
    assert seen == {"s": 2}


def test_own_extractor(spark):
    from dealsight.operators import spec

    spec.EXTRACTORS["x"] = lambda d: d.select(F.lit("own").alias("signal"))
    assert spec.EXTRACTORS["x"](spark.range(2)).count() == 2


def test_criteria_override(universe):
    c = tg.Criteria(min_cap=4e8)
    assert tg.screen(universe, NOW, c).filter("ticker = 'CMPX' AND passed").count() == 1
