"""The eight-factor rule set: factor scores, matching, signal combination and extraction."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import above, at_least, at_most, below, clamp, first_match, lookup, points, tidy
from dealsight.functions.clock import at, whole_days
from dealsight.functions.scale import join_on, previous_values, sliced
from dealsight.operators.events import related_counts

# ---- fixed values -----------------------------------------------------------
FACTOR_WEIGHTS = {"pipeline": 0.30, "runway": 0.18, "strategic_fit": 0.15, "patent": 0.12, "management": 0.10, "competition": 0.08,
                  "regulatory": 0.05, "history": 0.02}
PHASE_VALUE = {"preclinical": 10, "phase_1": 25, "phase_2": 50, "phase_3": 75, "nda_bla": 90, "approved": 100}
DESIGNATION_FACTOR = {"orphan": 1.3, "fast_track": 1.2, "breakthrough": 1.4, "priority_review": 1.3}
MARKET_POINTS = [(10e9, 50), (5e9, 40), (1e9, 30), (5e8, 20)]
P_VALUE = [(0.001, 100), (0.01, 85), (0.05, 70), (0.1, 40)]
PATENT_LIFE = [(15, 100), (10, 80), (5, 50), (2, 25)]
LITIGATION = {"none": 100, "defended": 90, "minor": 70, "major": 40, "invalidated": 10}
FREEDOM = {"clear": 100, "minor": 75, "licensed": 60, "blocked": 30, "multiple": 10}
PRESSURE = [(0.5, 100), (0.8, 85), (1.2, 60), (2.0, 35)]
URGENCY = {"phase_3": 1.5, "nda_filing": 1.4, "phase_2": 1.3, "partnership": 1.2, "none": 0.8}
MANAGEMENT = {"ceo_cfo_departure": 70, "board_addition": 80, "activist": 75, "advisor_hired": 90, "strategic_review": 95,
              "insider_buying": 65, "key_hire": 60, "rd_reduction": 55, "asset_sale": 70, "programme_end": 50}
MANAGEMENT_RECENCY = [(30, 1.0), (90, 0.8), (180, 0.6), (365, 0.4)]
SIZE_FIT = [(0.1, 30), (0.3, 50), (0.5, 75)]
SIZE_FIT_HIGH = [(4.0, 25), (2.5, 50), (1.5, 75)]
COMPETITOR_PENALTY = [(1, 0), (3, 15), (6, 35), (10, 50)]
APPROVED_PENALTY = [(0, 0), (2, 5), (5, 15), (10, 30)]
PATHWAY = {"clear": 100, "orphan": 90, "accelerated": 85, "standard": 75, "novel": 60, "guided": 50, "unclear": 30}
RISK = {"hold_current": 60, "hold_resolved": 20, "letter": 40, "letter_addressed": 15, "orphan_revoked": 25, "guidance": 30, "manufacturing": 20}
DEAL_FREQUENCY = [(11, 100), (6, 80), (3, 60), (1, 40)]
PREMIUM_TREND = [(100, 100), (75, 85), (50, 70), (25, 50)]
STAGES = ["preclinical", "phase_1", "phase_2", "phase_3", "nda_bla", "approved"]
COMPLETENESS = [(1.0, 1.0), (0.8, 0.9), (0.6, 0.8), (0.4, 0.6)]
FRESHNESS = [(30, 1.0), (90, 0.9), (180, 0.8), (365, 0.6)]
RELIABILITY = {"primary": 1.0, "company": 0.95, "secondary": 0.90, "news": 0.80, "social": 0.60}
DECAY = {"clinical": 0.003, "management": 0.006, "financial": 0.008, "market": 0.012, "regulatory": 0.004, "insider": 0.010}
VERIFIED = {"multiple": 1.0, "verified": 0.95, "single": 0.85, "rumor": 0.60}
CORRELATED = [("ceo_departure", "strategic_review", 0.7), ("insider_buying", "board_additions", 0.5), ("cash_runway", "asset_sale", 0.6),
              ("phase_3_start", "partnership_talks", 0.4), ("clinical_hold", "regulatory_guidance", 0.8)]
ITEM_SIGNALS = [("1.01", "partnership_announced", 1.0, 0.9), ("2.01", "acquisition_active", -0.5, 1.0), ("5.02", "leadership_turnover", 0.6, 0.7)]
PHASE_STEPS = {("Phase 1", "Phase 2"): 0.3, ("Phase 2", "Phase 3"): 0.7, ("Phase 3", "Completed"): 0.5}
MATCH_WEIGHTS = {"alignment": 0.25, "cliff_fit": 0.25, "valuation_fit": 0.20, "stage_fit": 0.15, "pattern": 0.10, "urgency": 0.05}
BASE_PROBABILITY = [(90, 0.35), (80, 0.25), (70, 0.18), (60, 0.12), (50, 0.07)]
MOMENTUM = [(0.5, "Accelerating", 5), (0.2, "Increasing", 2), (-0.2, "Stable", 0), (-0.5, "Decreasing", -2)]


def factor_pipeline(assets: DataFrame) -> DataFrame:
    """Phase x designation sum (40 %), novelty (25 %), indication (20 %), data quality (15 %), each in 0..100."""
    c = F.col
    mult = F.lit(1.0)
    for flag, m in DESIGNATION_FACTOR.items():
        mult = mult * F.when(c(flag), m).otherwise(1.0)
    others = assets.groupBy("indication", "mechanism").agg((F.count(F.lit(1)) - 1).alias("rivals"))
    a = join_on(assets, others, ["indication", "mechanism"])
    novelty = clamp(100 - c("rivals") * 5 + points(c("rivals") == 0, 30) - points(c("rivals") > 10, 40), 0.0, 100.0)
    need = first_match([(c("rivals") == 0, 50), (c("rivals") < 3, 35), (c("rivals") <= 10, 25)], 10)
    indication = above(c("peak_sales"), MARKET_POINTS, 10) + need
    quality = (F.when(c("endpoint_met"), 100).otherwise(20) * 0.4 + below(c("p_value"), P_VALUE, 10) * 0.3
               + at_least(c("effect"), [(1.0, 100), (0.7, 75), (0.3, 50)], 25) * 0.3)
    g = a.groupBy("company_id").agg(F.least(F.sum(lookup(c("phase"), PHASE_VALUE, 0) * mult), F.lit(100.0)).alias("_ph"), F.avg(novelty).alias("_nv"),
                                    F.max(indication).alias("_in"), F.max(quality).alias("_dq"))
    return g.select("company_id", tidy(c("_ph") * 0.40 + c("_nv") * 0.25 + F.least(c("_in"), F.lit(100)) * 0.20 + c("_dq") * 0.15).alias("score"))


def factor_patent(patents: DataFrame, as_of) -> DataFrame:
    """Best patent per company."""
    c = F.col
    years = whole_days(at(as_of), c("expiry_date")) / 365.25
    breadth = first_match([(c("is_composition"), 100), (c("is_formulation") & c("is_method"), 75), (c("is_method"), 50)], 25)
    s = (breadth * 0.35 + above(years, PATENT_LIFE, 10) * 0.30 + lookup(c("litigation"), LITIGATION, 10) * 0.20 + lookup(c("freedom"), FREEDOM, 10) * 0.15)
    return patents.groupBy("company_id").agg(F.max(tidy(s)).alias("score"))


def factor_runway(financials: DataFrame, catalysts: DataFrame, as_of) -> DataFrame:
    """Runway over months to the nearest catalyst, times its urgency, at most 100."""
    near = (catalysts.filter(F.col("catalyst_date") >= at(as_of)).groupBy("company_id")
            .agg(F.min_by(F.struct("catalyst_date", "kind"), F.struct("catalyst_date", "catalyst_id")).alias("n")))
    j = financials.join(near, "company_id", "left")
    months = whole_days(at(as_of), F.col("n.catalyst_date")) / 30.4
    run = F.when(F.col("burn_rate") > 0, F.col("cash") / F.col("burn_rate")).otherwise(999.0)
    pressure = below(F.try_divide(run, months), PRESSURE, 15)
    soon = F.when(months < 6, lookup(F.col("n.kind"), URGENCY, 1.0)).when(months.isNull(), 0.8).otherwise(1.0)
    return j.select("company_id", tidy(F.least(pressure * soon, F.lit(100.0))).alias("score"))


def factor_management(signals: DataFrame, as_of, window_days: int = 90) -> DataFrame:
    """Base value x recency x magnitude, summed and held to 100."""
    d = related_counts(signals, "company_id", "event_date", "signal_id", window_days)
    days = whole_days(F.col("event_date"), at(as_of))
    size = F.when(F.col("related") >= 1, 1.3).when(F.col("weak"), 0.7).otherwise(1.0)
    v = lookup(F.col("kind"), MANAGEMENT, 0) * below(days, MANAGEMENT_RECENCY, 0.2) * size
    return d.groupBy("company_id").agg(F.least(F.sum(F.round(v, 6).cast("decimal(18,6)")).cast("double"), F.lit(100.0)).alias("_s")).select("company_id", tidy(F.col("_s")).alias("score"))


def size_score(ratio: Column) -> Column:
    return first_match([(ratio < b, v) for b, v in SIZE_FIT] + [(ratio > b, v) for b, v in SIZE_FIT_HIGH], 100)


def factor_strategic_fit(companies: DataFrame, acquirers: DataFrame, deals: DataFrame, as_of) -> DataFrame:
    """Buyers per core area, technology, geography, deal size ratio and gaps; one row per area feeds the join."""
    core = acquirers.select(F.explode("areas").alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("buyers"))
    gaps = acquirers.select(F.explode("gaps").alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("gap_buyers"))
    typical = deals.filter(F.col("deal_date") >= F.add_months(at(as_of), -60)).groupBy("area").agg(F.avg("deal_value").alias("typical"))
    dim = core.join(gaps, "area", "full_outer").join(typical, "area", "full_outer")
    j = companies.join(dim, companies.lead_area == dim.area, "left")
    c = F.col
    align = at_least(F.coalesce("buyers", F.lit(0)), [(3, 100), (1, 75)], 10)
    gap = F.when(F.coalesce("gap_buyers", F.lit(0)) > 0, 80).otherwise(40)
    size = F.when(c("typical").isNotNull(), size_score(c("market_cap") / c("typical"))).otherwise(25)
    return j.select("company_id", tidy(align * 0.30 + c("technology_fit") * 0.25 + c("geographic_fit") * 0.15 + size * 0.20 + gap * 0.10).alias("score"))


def factor_competition(assets: DataFrame) -> DataFrame:
    """Penalties for rivals of the same indication and mechanism and for approved therapies; best programme per company."""
    c = F.col
    rivals = assets.groupBy("indication", "mechanism").agg((F.count(F.lit(1)) - 1).alias("rivals"))
    done = assets.groupBy("indication").agg(F.count_if(c("phase") == "approved").alias("approved"))
    d = join_on(join_on(assets, rivals, ["indication", "mechanism"]), done, ["indication"])
    adj = (points(c("novelty") == "best_in_class", -20) + points(c("novelty") == "first_in_class", -15) + points(c("superior"), -25)
           + points(c("novelty") == "me_too", 30))
    pen = at_most(c("rivals"), COMPETITOR_PENALTY, 70) + at_most(c("approved"), APPROVED_PENALTY, 50) + adj
    return d.groupBy("company_id").agg(F.max(clamp((100 - pen).cast("double"), 0.0, 100.0)).alias("score"))


def factor_regulatory(companies: DataFrame, risks: DataFrame) -> DataFrame:
    """Pathway score less one penalty per kind of issue seen."""
    seen = risks.select("company_id", "risk").distinct().groupBy("company_id").agg(F.sum(lookup(F.col("risk"), RISK, 0)).alias("_p"))
    j = companies.select("company_id", "pathway").join(seen, "company_id", "left")
    return j.select("company_id", clamp((lookup(F.col("pathway"), PATHWAY, 30) - F.coalesce("_p", F.lit(0))).cast("double"), 0.0, 100.0).alias("score"))


def factor_history(companies: DataFrame, deals: DataFrame, as_of) -> DataFrame:
    """Deals and premiums of the lead area over 36 months, and how its stage compares with deals done."""
    d = deals.filter(F.col("deal_date") >= F.add_months(at(as_of), -36))
    area = d.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.avg("premium").alias("premium"))
    st = d.groupBy("area", "stage").agg(F.count(F.lit(1)).alias("k"))
    mode = st.groupBy("area").agg(F.max_by("stage", F.struct("k", "stage")).alias("mode"))
    j = (companies.select("company_id", F.col("lead_area").alias("area"), F.col("lead_phase").alias("stage"))
         .join(area.join(mode, "area"), "area", "left").join(st, ["area", "stage"], "left"))
    order = {s: i for i, s in enumerate(STAGES)}
    near = F.abs(lookup(F.col("stage"), order) - lookup(F.col("mode"), order)) == 1
    k, n = F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0))
    fit = first_match([(F.col("stage") == F.col("mode"), 100), (near, 75), ((k > 0) & (k / n >= 0.1), 50), (k > 0, 25)], 10)
    return j.select("company_id", tidy(at_least(n, DEAL_FREQUENCY, 20) * 0.4 + above(F.coalesce("premium", F.lit(0.0)), PREMIUM_TREND, 30) * 0.3 + fit * 0.3).alias("score"))


def data_factor(completeness: Column, age_days: Column, source: Column) -> Column:
    """D = completeness x recency x reliability."""
    return at_least(completeness, COMPLETENESS, 0.4) * below(age_days, FRESHNESS, 0.4) * lookup(source, RELIABILITY, 0.6)


def eight_factor_score(factors: DataFrame, weights: Mapping[str, float] = FACTOR_WEIGHTS) -> DataFrame:
    """Sum of weight x score x D over long (company_id, factor, score, d) rows."""
    v = lookup(F.col("factor"), weights, 0.0) * F.col("score") * F.col("d")
    return factors.groupBy("company_id").agg(tidy(clamp(F.sum(v), 0.0, 100.0)).alias("score"), F.count(F.lit(1)).alias("factors"))


def spec_matching_score(pairs: DataFrame) -> DataFrame:
    """Six components, match score and acquisition probability over proposed pairs."""
    c = F.col
    align = F.least(lookup(c("priority"), {"high": 100.0, "medium": 52.5, "low": 20.0, "adjacent": 9.0}, 0.0)
                    + lookup(c("technology"), {"match": 15, "complementary": 10}, 0), F.lit(100.0))
    off = F.abs(c("months_to_cliff") - c("months_to_approval"))
    cliff = (at_most(off, [(6, 100), (12, 80), (24, 60), (36, 40)], 20) * 0.6 + lookup(c("cliff_match"), {"indication": 100, "area": 75, "related": 50}, 25) * 0.3
             + F.least(c("sales_ratio") * 100, F.lit(100.0)) * 0.1)
    r = c("size_ratio")
    deal_size = first_match([(r < 0.1, 20), (r < 0.2, 40), (r < 0.3, 60), (r < 0.5, 80), (r > 6.0, 20), (r > 4.0, 40), (r > 2.5, 60), (r > 1.5, 80)], 100)
    stage = lookup(c("stage_match"), {"preferred": 90, "adjacent": 70, "acceptable": 50}, 30) + lookup(c("data_state"), {"phase_3_positive": 10, "phase_2_strong": 8, "phase_2_early": 5}, 3)
    pattern = (first_match([(c("deals_in_area") > 5, 100), (c("deals_in_area") >= 3, 80), (c("deals_in_area") >= 1, 60)], 20) * 0.4
               + first_match([(c("deals_at_stage") > 3, 100), (c("deals_at_stage") >= 2, 75), (c("deals_at_stage") == 1, 50)], 25) * 0.3 + deal_size * 0.3)
    gap = at_least(c("product_gap"), [(3, 100), (2, 75), (1, 50), (0, 25)], 10)
    growth = c("revenue_growth")
    market = first_match([(growth < -10, 100), (growth <= 0, 70), (growth < 5, 50), (growth <= 10, 30)], 10)
    urgency = gap * 0.5 + market * 0.3 + lookup(c("threat"), {"launched": 100, "phase_3": 80, "erosion": 70}, 30) * 0.2
    d = (pairs.withColumn("alignment", align).withColumn("cliff_fit", cliff).withColumn("valuation_fit", deal_size * F.least(c("funding_ratio"), F.lit(1.0)))
         .withColumn("stage_fit", stage.cast("double")).withColumn("pattern", pattern).withColumn("urgency", urgency))
    total = sum((c(k) * w for k, w in MATCH_WEIGHTS.items()), F.lit(0.0))
    d = d.withColumn("match_score", tidy(total))
    crowd = first_match([(c("strong_80") >= 2, 1.5), (c("strong_70") >= 2, 1.3), (c("strong_70") == 1, 1.0)], 0.7)
    m = c("months_to_catalyst")
    timing = first_match([((m < 6) & c("low_runway"), 1.4), (m < 6, 1.2), (m <= 12, 1.2), (m <= 18, 1.0), (m > 18, 0.8)], 0.6)
    return d.withColumn("probability", tidy(F.least(at_least(c("target_score"), BASE_PROBABILITY, 0.03) * crowd * timing, F.lit(1.0)), 4))


def signal_combination(signals: DataFrame, as_of) -> DataFrame:
    """Confidence and recency weighted mean per company and type.

    ``confidence_now`` is the mean confidence after recency decay and verification.
    """
    days = whole_days(F.col("event_date"), at(as_of))
    w = F.exp(-lookup(F.col("family"), DECAY, 0.01) * days)
    g = signals.withColumn("_w", w).groupBy("company_id", "kind").agg(
        F.try_divide(F.sum(F.col("value") * F.col("_w") * F.col("confidence")), F.sum(F.col("_w") * F.col("confidence"))).alias("combined"),
        F.avg(F.col("confidence") * F.col("_w") * lookup(F.col("verification"), VERIFIED, 0.6)).alias("confidence_now"))
    return g.withColumn("combined", F.coalesce("combined", F.lit(0.0)))


def correlation_discount(combined: DataFrame, pairs=CORRELATED) -> DataFrame:
    """Per company, A + B(1 - r) whenever both types of a correlated pair are present."""
    spark = combined.sparkSession
    dim = F.broadcast(spark.createDataFrame([(b, a, r) for a, b, r in pairs], "kind string, partner string, r double"))
    have = combined.select("company_id", F.col("kind").alias("partner"), F.lit(True).alias("_both"))
    d = combined.join(dim, "kind", "left").join(have, ["company_id", "partner"], "left")
    adj = F.col("combined") * F.when(F.col("_both"), 1 - F.col("r")).otherwise(1.0)
    return d.groupBy("company_id").agg(F.sum(adj).alias("adjusted"), F.sum("combined").alias("plain"), F.count_if("_both").alias("discounts"))


def filing_signals(filings: DataFrame) -> DataFrame:
    """One signal per mapped item of an enriched filing."""
    dim = F.broadcast(filings.sparkSession.createDataFrame(ITEM_SIGNALS, "item string, signal string, strength double, confidence double"))
    return filings.withColumn("item", F.explode("items")).join(dim, "item")


def trial_signals(updates: DataFrame, key: str = "trial_id") -> DataFrame:
    """Phase steps against the previous update and terminations."""
    d = previous_values(sliced(updates, [key], ["ts", "event_id"]), [key], F.col("_slice"), ["ts", "event_id"], {"previous_phase": "phase"}).drop("_slice")
    step = first_match([((F.col("previous_phase") == a) & (F.col("phase") == b), v) for (a, b), v in PHASE_STEPS.items()], None)
    sig = F.array(F.when(step.isNotNull(), F.struct(F.lit("clinical_progression").alias("signal"), step.cast("double").alias("strength"), F.lit(0.8).alias("confidence"))),
                  F.when(F.col("status") == "Terminated", F.struct(F.lit("clinical_failure").alias("signal"), F.lit(0.8).alias("strength"), F.lit(0.9).alias("confidence"))))
    return d.withColumn("_s", F.explode(F.filter(sig, lambda x: x.isNotNull()))).select("*", "_s.*").drop("_s")


# Event type -> extractor; a caller adds its own DataFrame function
EXTRACTORS = {"filing.sec.8k": filing_signals, "clinical.trial.updated": trial_signals}


def extract_signals(events: Mapping[str, DataFrame], columns: Sequence[str] = ("signal", "strength", "confidence")) -> DataFrame:
    """(event_type, *columns) of every event type with a registered extractor; the other types give no rows."""
    out = None
    for kind in sorted(set(events) & set(EXTRACTORS)):
        d = EXTRACTORS[kind](events[kind])
        d = d.select(F.lit(kind).alias("event_type"), *[F.col(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in columns])
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise KeyError("no extractor registered for any of the event types")
    return out


def signal_momentum(signals: DataFrame, as_of, recent: int = 30, baseline: int = 180) -> DataFrame:
    """recent count against the mean count per equal period of the trailing baseline."""
    ago = lambda d: at(as_of) - F.expr(f"INTERVAL {int(d)} DAYS")
    t = F.col("event_date")
    g = signals.filter(t >= ago(baseline)).groupBy("company_id").agg(F.count_if(t >= ago(recent)).alias("recent"), F.count(F.lit(1)).alias("_all"))
    m = F.round(F.col("recent") / (F.col("_all") * recent / baseline) - 1, 9)
    d = g.withColumn("momentum", m)
    x = F.col("momentum")
    lab = first_match([(x > 0.5, "Accelerating"), (x > 0.2, "Increasing"), (x >= -0.2, "Stable"), (x >= -0.5, "Decreasing")], "Decelerating")
    d = d.withColumn("category", lab)
    return d.withColumn("points", lookup(F.col("category"), {n: p for _, n, p in MOMENTUM}, -5)).drop("_all")
