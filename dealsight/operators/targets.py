"""Target identification: screening gates, readiness factors, ranking, deal odds."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import above, at_least, at_most, below, clamp, first_match, lookup, points
from dealsight.functions.clock import at, whole_days
from dealsight.functions.scale import cut, latest_per_key, positions

# ---- fixed values -----------------------------------------------------------
PRIORITY_AREAS = ["obesity_glp1", "oncology_adc", "radiopharmaceuticals", "autoimmune", "cns_neuropsychiatry", "rare_disease"]
HOT_AREAS = ["obesity_glp1", "radiopharmaceuticals", "oncology_adc"]
REGIONS = ["North America", "Europe", "Asia"]
PHASE_RANK = {"Preclinical": 0, "Phase 1": 1, "Phase 2": 2, "Phase 3": 3, "NDA/BLA Filed": 4, "Approved": 5}
QUALITY_BY_PHASE = {"Preclinical": 10, "Phase 1": 20, "Phase 2": 40, "Phase 3": 70, "NDA/BLA Filed": 85, "Approved": 60}
STAGE_SCORE = {"Preclinical": 20, "Phase 1": 40, "Phase 2": 90, "Phase 3": 95, "NDA/BLA Filed": 75, "Approved": 50}
AREA_SCORE = {"obesity_glp1": 100, "radiopharmaceuticals": 95, "oncology_adc": 90, "autoimmune": 85,
              "cns_neuropsychiatry": 80, "rare_disease": 75, "gene_therapy": 70, "immunology": 65,
              "cardiovascular": 60, "infectious_disease": 55}
CATALYST_SCORE = {"phase3_topline": 30, "phase2_data": 25, "nda_filing": 20, "partnership": 15, "phase1_data": 10}
POSITION_SCORE = {"leader": 50, "co_leader": 45, "fast_follower": 40, "follower": 25, "laggard": 10}
SENTIMENT_SCORE = {"bearish": 30, "neutral": 20, "bullish": 10}
COMPLEXITY = {"low": 15, "medium": 0, "high": -15}
RANKING_WEIGHTS = {"pipeline_quality": 0.10, "market_cap_fit": 0.08, "cash_runway": 0.10, "therapeutic_area": 0.09,
                   "clinical_stage": 0.08, "financial_distress": 0.05, "scientific_differentiation": 0.12,
                   "acquisition_tension": 0.10, "strategic_acquirer_fit": 0.10, "data_catalyst_timing": 0.08,
                   "competitive_landscape": 0.06, "deal_structure_feasibility": 0.04}
# inputs the identification job fills in when the universe has no such column
ASSUMED = {"has_positive_phase2_data": True, "has_differentiated_moa": True, "num_likely_acquirers": 3,
           "fills_portfolio_gap": True, "months_to_next_catalyst": 6, "num_catalysts_12mo": 2,
           "competitive_position": "fast_follower", "num_direct_competitors": 5, "regulatory_complexity": "medium"}
NEUTRAL = {"has_positive_phase2_data": False, "has_differentiated_moa": False, "num_likely_acquirers": 0,
           "fills_portfolio_gap": False, "months_to_next_catalyst": 999, "num_catalysts_12mo": 0,
           "competitive_position": "follower", "num_direct_competitors": 10, "regulatory_complexity": "medium",
           "analyst_sentiment": "neutral", "has_novel_moa": False, "has_proprietary_platform": False,
           "has_best_in_class_data": False, "patent_life_years": 0, "has_recent_partnership": False,
           "has_activist_investor": False, "has_takeover_rumors": False, "is_only_asset_in_space": False,
           "has_orphan_designation": False, "complements_existing_portfolio": False, "existing_sales_force_fit": False,
           "geographic_fit": False, "has_combination_potential": False, "similar_therapeutic_focus": False,
           "next_catalyst_type": "", "recent_competitor_setback": False, "recent_competitor_approval": False,
           "has_antitrust_risk": False}
LIKELY_BUYERS = {
    "obesity_glp1": [("Novo Nordisk", "Big Pharma", 95), ("Eli Lilly", "Big Pharma", 90), ("Roche", "Big Pharma", 75), ("AstraZeneca", "Big Pharma", 70)],
    "oncology_adc": [("Daiichi Sankyo", "Big Pharma", 95), ("AbbVie", "Big Pharma", 85), ("Merck", "Big Pharma", 80), ("Gilead", "Big Pharma", 75)],
    "radiopharmaceuticals": [("Novartis", "Big Pharma", 90), ("Eli Lilly", "Big Pharma", 85), ("Bristol Myers Squibb", "Big Pharma", 75), ("AstraZeneca", "Big Pharma", 70)],
    "autoimmune": [("Johnson & Johnson", "Big Pharma", 90), ("AbbVie", "Big Pharma", 85), ("Amgen", "Big Pharma", 80), ("UCB", "Specialty Pharma", 75)],
    "cns_neuropsychiatry": [("AbbVie", "Big Pharma", 90), ("Bristol Myers Squibb", "Big Pharma", 85), ("Takeda", "Big Pharma", 80), ("Otsuka", "Specialty Pharma", 70)],
    "rare_disease": [("Sanofi", "Big Pharma", 85), ("Takeda", "Big Pharma", 80), ("Ultragenyx", "Large Biotech", 75), ("BioMarin", "Large Biotech", 70)],
}
DEFAULT_BUYERS = [("Pfizer", "Big Pharma", 70), ("Roche", "Big Pharma", 65), ("Merck", "Big Pharma", 60)]


@dataclass(frozen=True)
class Criteria:
    """Screening limits; override any field."""
    min_cap: float = 5e8
    max_cap: float = 5e10
    min_phase: int = 2
    require_lead_asset: bool = True
    min_assets: int = 1
    min_runway: float = 12
    max_runway: float = 36
    max_monthly_burn: float | None = None
    priority_areas: Sequence[str] = field(default_factory=lambda: PRIORITY_AREAS)
    hot_areas: Sequence[str] = field(default_factory=lambda: HOT_AREAS)
    regions: Sequence[str] = field(default_factory=lambda: REGIONS)
    worst_return: float = -80
    min_held: float = 0.2
    max_held: float = 0.95
    exclude_preclinical_only: bool = True
    exclude_royalty: bool = True
    exclude_recent_ipo: bool = True
    ipo_months: float = 12


GATES = ("market_cap", "assets", "finance", "strategy", "exclusions")


def _any_area(wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap("therapeutic_areas", F.array(*[F.lit(a) for a in wanted])), F.lit(False))


def with_runway(universe: DataFrame) -> DataFrame:
    burn = F.col("quarterly_burn_rate")
    return universe.withColumn("cash_runway_months", F.when(burn <= 0, F.lit(999.0)).otherwise(F.col("cash_position") / (burn / 3)))


def screen(universe: DataFrame, as_of, c: Criteria = Criteria()) -> DataFrame:
    """One flag per gate, the first failing gate and ``passed``."""
    d = with_runway(universe)
    run, rank = F.col("cash_runway_months"), F.col("lead_rank")
    exception = _any_area(c.hot_areas) | F.col("is_platform") | (rank >= PHASE_RANK["Phase 3"])
    assets = (rank >= c.min_phase) & (F.col("total_assets") >= c.min_assets)
    if c.require_lead_asset:
        assets = assets & F.coalesce(F.col("lead_asset") != "", F.lit(False))
    finance = (run >= c.min_runway) & ((run <= c.max_runway) | exception)
    if c.max_monthly_burn:
        finance = finance & (F.col("quarterly_burn_rate") / 3 <= c.max_monthly_burn)
    strategy = (_any_area(c.priority_areas) & F.col("region").isin(list(c.regions))
                & (F.col("stock_return_52w") >= c.worst_return)
                & F.col("institutional_ownership").between(c.min_held, c.max_held))
    bad = F.lit(False)
    if c.exclude_preclinical_only:
        bad = bad | ((rank == 0) & (F.col("total_assets") == 1))
    if c.exclude_royalty:
        bad = bad | F.col("is_royalty")
    if c.exclude_recent_ipo:
        months = whole_days(F.col("ipo_date").cast("timestamp_ntz"), at(as_of)) / 30
        bad = bad | F.coalesce(months < c.ipo_months, F.lit(False))
    gates = {"market_cap": F.col("market_cap").between(c.min_cap, c.max_cap), "assets": assets, "finance": finance,
             "strategy": strategy, "exclusions": ~bad}
    for g in GATES:
        d = d.withColumn(f"gate_{g}", F.coalesce(gates[g], F.lit(False)))
    failed = F.coalesce(*[F.when(~F.col(f"gate_{g}"), F.lit(g)) for g in GATES])
    return d.withColumn("failed_gate", failed).withColumn("passed", failed.isNull())


def screen_funnel(screened: DataFrame) -> DataFrame:
    """Rows left after each gate and the pass rate."""
    aggs, cond = [F.count(F.lit(1)).alias("reviewed")], F.lit(True)
    for g in GATES:
        cond = cond & F.col(f"gate_{g}")
        aggs.append(F.count_if(cond).alias(f"passed_{g}"))
    return screened.agg(*aggs).withColumn("pass_rate", F.coalesce(F.try_divide(F.col(f"passed_{GATES[-1]}"), F.col("reviewed")), F.lit(0.0)))


def priority_targets(screened: DataFrame, focus: Sequence[str] = PRIORITY_AREAS) -> DataFrame:
    """Passed, in focus, and short of cash, late stage or distressed."""
    run = F.col("cash_runway_months")
    distressed = (run < 18) | (F.col("stock_return_52w") < -50)
    return screened.filter(F.col("passed") & _any_area(focus) & ((run < 24) | (F.col("lead_rank") >= 3) | distressed))


def readiness_factors(companies: DataFrame, given: Mapping[str, object] = ASSUMED) -> DataFrame:
    """Twelve 0-100 factors; a missing input column takes ``given`` or the neutral value."""
    def c(name: str) -> Column:
        if name in companies.columns and name not in given:
            return F.coalesce(F.col(name), F.lit(NEUTRAL[name])) if name in NEUTRAL else F.col(name)
        return F.lit(given.get(name, NEUTRAL.get(name)))

    cap, run, ret = F.col("market_cap") / 1e9, F.col("cash_runway_months"), F.col("stock_return_52w")
    held = F.col("institutional_ownership")
    inside = lambda x, lo, hi: (x >= lo) & (x <= hi)
    best_area = F.coalesce(F.array_max(F.transform("therapeutic_areas", lambda a: lookup(a, AREA_SCORE, 40))), F.lit(30))
    months, antitrust = c("months_to_next_catalyst"), c("has_antitrust_risk")
    f = {
        "pipeline_quality": F.least(F.col("total_assets") * 10, F.lit(30)) + lookup(F.col("lead_asset_phase"), QUALITY_BY_PHASE, 0) * 0.4
        + points(c("has_positive_phase2_data"), 20) + points(c("has_differentiated_moa"), 16),
        "market_cap_fit": first_match([(inside(cap, 1, 5), 100), ((cap > 5) & (cap <= 10), 90), ((cap > 10) & (cap <= 15), 75),
                                       ((cap >= 0.5) & (cap < 1), 85), ((cap > 15) & (cap <= 25), 60), ((cap > 25) & (cap <= 50), 40)], 20),
        "cash_runway": first_match([(inside(run, 12, 18), 100), ((run > 18) & (run <= 24), 90), ((run >= 9) & (run < 12), 80),
                                    ((run > 24) & (run <= 36), 70), ((run >= 6) & (run < 9), 60), ((run > 36) & (run <= 48), 50)], 30),
        "therapeutic_area": best_area,
        "clinical_stage": lookup(F.col("lead_asset_phase"), STAGE_SCORE, 30),
        "financial_distress": first_match([(inside(ret, -40, -20), 40), ((ret >= -60) & (ret < -40), 35), ((ret >= -20) & (ret < 0), 30), (ret < -60, 20)], 10)
        + first_match([(inside(run, 12, 18), 30), ((run > 18) & (run <= 24), 25), (run < 12, 15)], 10)
        + lookup(c("analyst_sentiment"), SENTIMENT_SCORE, 15),
        "scientific_differentiation": first_match([(c("has_novel_moa"), 30), (c("has_differentiated_moa"), 20)], 0)
        + points(c("has_proprietary_platform"), 25)
        + first_match([(c("has_best_in_class_data"), 25), (c("has_positive_phase2_data"), 15)], 0)
        + at_least(c("patent_life_years"), [(15, 20), (10, 15), (5, 10)], 0),
        "acquisition_tension": F.least(c("num_likely_acquirers") * 10, F.lit(40)) + points(c("has_takeover_rumors"), 15)
        + points(c("has_activist_investor"), 10) + points(c("has_recent_partnership"), 5)
        + points(c("is_only_asset_in_space"), 20) + points(c("has_orphan_designation"), 10),
        "strategic_acquirer_fit": first_match([(c("fills_portfolio_gap"), 35), (c("complements_existing_portfolio"), 25)], 0)
        + points(c("existing_sales_force_fit"), 20) + points(c("geographic_fit"), 10)
        + points(c("has_combination_potential"), 20) + points(c("similar_therapeutic_focus"), 15),
        "data_catalyst_timing": first_match([(inside(months, 1, 3), 40), ((months > 3) & (months <= 6), 35),
                                             ((months > 6) & (months <= 12), 25), (months > 12, 10)], 0)
        + lookup(c("next_catalyst_type"), CATALYST_SCORE, 5) + F.least(c("num_catalysts_12mo") * 10, F.lit(30)),
        "competitive_landscape": lookup(c("competitive_position"), POSITION_SCORE, 20)
        + at_most(c("num_direct_competitors"), [(2, 25), (5, 20), (10, 10)], 5)
        + points(c("recent_competitor_setback"), 20) + F.when(c("recent_competitor_approval"), -10).otherwise(5),
        "deal_structure_feasibility": F.lit(70) - points(antitrust, 30) + lookup(c("regulatory_complexity"), COMPLEXITY, 0)
        + first_match([(held >= 0.7, 15), (held < 0.3, -10)], 0),
    }
    out = companies
    for name, col in f.items():
        out = out.withColumn(name, clamp(col.cast("double"), 0.0, 100.0))
    return out


def rank_targets(factors: DataFrame, weights: Mapping[str, float] = RANKING_WEIGHTS, top_n: int | None = None) -> DataFrame:
    """Weighted score, rank, percentile, strengths, weaknesses and thesis."""
    if abs(sum(weights.values()) - 1.0) > 0.001:
        raise ValueError(f"weights must total 1, got {sum(weights.values())}")
    score = sum((F.col(k) * F.lit(w) for k, w in weights.items()), F.lit(0.0))
    names = list(weights)
    title = lambda k: k.replace("_", " ").title()
    entry = lambda k, sign, i: F.struct((F.col(k) * sign).alias("k"), F.lit(i).alias("i"),
                                        F.format_string(f"{title(k)} (%.0f/100)", F.col(k)).alias("t"), F.col(k).alias("v"))
    pickn = lambda sign: F.slice(F.array_sort(F.array(*[entry(k, sign, i) for i, k in enumerate(names)])), 1, 3)
    d = factors.withColumn("composite", F.round(score, 9))
    d = (d.withColumn("key_strengths", F.transform(F.filter(pickn(-1), lambda x: x["v"] >= 70), lambda x: x["t"]))
         .withColumn("key_weaknesses", F.transform(F.filter(pickn(1), lambda x: x["v"] <= 50), lambda x: x["t"])))
    why = F.concat(F.when(F.col("scientific_differentiation") >= 80, "Strong scientific differentiation and ").otherwise(""),
                   F.when(F.col("acquisition_tension") >= 80, "high competitive acquisition tension make it ")
                   .otherwise("Strategic fit and timing make it "))
    area = F.replace(F.coalesce(F.try_element_at("therapeutic_areas", F.lit(1)), F.lit("Unknown")), F.lit("_"), F.lit(" "))
    d = d.withColumn("thesis", F.concat(F.format_string("%s (%s) is a $%.1fB %s company with a %s lead asset. ", "name", "ticker",
                                                        F.col("market_cap") / 1e9, area, "lead_asset_phase"),
                                        why, F.lit("an attractive M&A target.")))
    # the range split samples its input first, so the scored universe is computed once up front
    p = positions(cut(d), [], [F.col("composite").desc(), F.col("ticker")], "rank", "_n")
    p = p.withColumn("percentile", (F.col("_n") - F.col("rank") + 1) / F.col("_n") * 100).drop("_n")
    return p.filter(F.col("rank") <= top_n) if top_n else p


def deal_probability(ranked: DataFrame) -> DataFrame:
    """12 and 24 month odds and the value range."""
    run = F.col("cash_runway_months")
    p = (F.col("composite") / 100 * 0.5 + below(run, [(15, 0.2), (24, 0.15), (36, 0.05)], 0.0)
         + points(F.col("stock_return_52w") < -40, 0.1) + points(F.col("has_activist_investor"), 0.15)
         + points(F.col("has_takeover_rumors"), 0.1))
    d = ranked.withColumn("probability_12mo", F.least(p, F.lit(0.85)))
    d = d.withColumn("probability_24mo", F.least(F.col("probability_12mo") * 1.6, F.lit(0.95)))
    for name, mult in (("low", 1.3), ("base", 1.5), ("high", 1.8)):
        d = d.withColumn(f"value_{name}", F.col("market_cap") * mult)
    return d


def buyers_table(spark, buyers=LIKELY_BUYERS, default=DEFAULT_BUYERS) -> DataFrame:
    rows = [(a, i, b[0], b[1], float(b[2])) for a, bs in {**buyers, "": default}.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "area string, seq int, name string, buyer_type string, fit double")


def area_acquirers(targets: DataFrame, buyers: DataFrame) -> DataFrame:
    """Likely buyers of the first area (default list otherwise) and the best of them."""
    per_area = (buyers.withColumn("probability", F.col("fit") / 100 * 0.4).withColumn("premium", 40 + F.col("fit") / 100 * 20)
                .groupBy("area").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "buyer_type", "fit", "probability", "premium"))).alias("acquirers")))
    dim = per_area  # one row per area
    usual = F.broadcast(per_area.filter("area = ''").select(F.col("acquirers").alias("_default"), F.lit(1).alias("_one")))
    d = (targets.withColumn("area", F.coalesce(F.try_element_at("therapeutic_areas", F.lit(1)), F.lit(""))).withColumn("_one", F.lit(1))
         .join(dim, "area", "left").join(usual, "_one").drop("_one")
         .withColumn("acquirers", F.coalesce("acquirers", "_default")).drop("_default"))
    best = F.aggregate("acquirers", F.col("acquirers")[0], lambda a, b: F.when(b["probability"] > a["probability"], b).otherwise(a))
    return d.withColumn("top_acquirer", best)


def next_catalyst(catalysts: DataFrame, as_of) -> DataFrame:
    """Earliest High / Critical catalyst per company (undated last) and days until it."""
    d = catalysts.filter(F.col("importance").isin("High", "Critical"))
    far = F.coalesce("expected_date", F.lit("9999-12-31").cast("timestamp_ntz"))
    g = d.groupBy("company_id").agg(F.min_by(F.struct("event_type", "expected_date"), F.struct(far, "catalyst_id")).alias("n"))
    return g.select("company_id", "n.event_type", "n.expected_date",
                    whole_days(at(as_of), F.col("n.expected_date")).alias("days_until"))


def identify_targets(universe: DataFrame, as_of, criteria: Criteria = Criteria(), top_n: int | None = 20,
                     given: Mapping[str, object] | None = None) -> DataFrame:
    """Screen, rank, then look the ranked tickers up in the raw universe (first row per ticker).

    The ranking step sees only the profile; every other factor input is the
    assumed or neutral value.  Deal odds read the raw universe again.
    """
    given = {**NEUTRAL, **ASSUMED} if given is None else given
    passed = screen(universe, as_of, criteria).filter("passed")
    ranked = rank_targets(readiness_factors(passed, given), top_n=top_n)
    first = latest_per_key(universe.select("ticker", F.col("market_cap").alias("raw_cap"), "company_id").withColumn("_neg", -F.col("company_id")),
                           ["ticker"], ["_neg"]).drop("_neg", "company_id")
    return deal_probability(ranked.join(first, "ticker"))


def watchlist_statistics(entries: DataFrame) -> DataFrame:
    """D30."""
    return entries.agg(F.count(F.lit(1)).alias("targets"), F.avg("composite").alias("avg_score"), F.avg("market_cap").alias("avg_cap"),
                       F.avg("probability_12mo").alias("avg_probability"), F.sum("value_base").alias("total_value"),
                       F.count_distinct("area").alias("areas"), F.count_if(F.col("probability_12mo") >= 0.4).alias("high_probability"))
