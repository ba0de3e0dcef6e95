"""Market concentration, antitrust risk, clinical differentiation and deal premium."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.bands import above, at_least, below, clamp, first_match, lookup, points, tidy, truthy
from dealsight.functions.scale import join_on

# ---- fixed values -----------------------------------------------------------
SHARE_RISK = [(50, 100), (40, 85), (30, 70), (20, 50), (10, 30)]
SIZE_RISK = [(10000, 80.0), (5000, 60.0), (1000, 40.0), (100, 25.0)]
CLIMATE = 1.3
RISK_LEVELS = [(80, "very_high"), (60, "high"), (40, "moderate"), (20, "low")]
REVIEW = [(80, "blocked or withdrawn", "18-24+", 0.95, 0.8), (60, "approved with significant remedies", "12-18", 0.85, 0.7),
          (40, "approved with minor remedies", "8-12", 0.5, 0.4), (20, "approved", "4-6", 0.2, 0.1)]
REVIEW_MIN = ("approved", "2-4", 0.05, 0.0)
DOSING = {"once_monthly": 100, "twice_monthly": 85, "once_weekly": 75, "twice_weekly": 65, "once_daily": 50,
          "twice_daily": 35, "three_times_daily": 25, "as_needed": 40}
ROUTE = {"oral": 1.2, "subcutaneous": 1.0, "transdermal": 1.1, "inhaled": 0.95, "intramuscular": 0.85, "intravenous": 0.7, "other": 0.8}
NOVELTY = {"first_in_class": 100, "best_in_class": 85, "fast_follower": 60, "me_too": 30}
TENSION_RANGE = [(90, 2.5, 4.0), (75, 1.8, 2.5), (60, 1.4, 1.8), (40, 1.1, 1.4)]
TENSION_MIN = (0.9, 1.1)
SCARCITY_ADD = [(90, 0.25), (80, 0.15), (70, 0.08)]
ANTITRUST_CUT = [(80, 0.5), (60, 0.3), (40, 0.15), (20, 0.05)]
PREMIUM_TIER = [(150, "extreme"), (100, "high"), (70, "above_average"), (40, "average"), (20, "below_average"), (0, "minimal")]


def market_shares(sales: DataFrame, market: str = "market", company: str = "company_id", value: str = "sales") -> DataFrame:
    """Percent share per (market, company); totals are aggregated and joined back."""
    per = sales.groupBy(market, company).agg(F.sum(value).alias("sales"))
    total = per.groupBy(market).agg(F.sum("sales").alias("_t"))
    return per.join(total, market).withColumn("share", F.col("sales") / F.col("_t") * 100).drop("_t")


def market_hhi(shares: DataFrame, market: str = "market") -> DataFrame:
    return shares.groupBy(market).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))


def concentration_band(hhi: Column) -> Column:
    return F.when(hhi > 2500, "high").when(hhi > 1500, "moderate").otherwise("unconcentrated")


def merger_hhi(proposals: DataFrame, shares: DataFrame) -> DataFrame:
    """For each proposed (buyer, target) and market both sell in: HHI, delta = 2ab, post-merger HHI.

    A proposal is laid out over the markets of the company that sells in fewer, and looks up the other one there.
    """
    count = shares.groupBy("company_id").agg(F.count(F.lit(1)).alias("_n"))
    p = proposals.filter("buyer_id <> target_id")
    for side in ("buyer", "target"):
        p = p.join(count.select(F.col("company_id").alias(f"{side}_id"), F.col("_n").alias(f"_{side}")), f"{side}_id")
    few = F.col("_buyer") <= F.col("_target")
    p = p.withColumn("_one", F.when(few, F.col("buyer_id")).otherwise(F.col("target_id"))).withColumn("_two", F.when(few, F.col("target_id")).otherwise(F.col("buyer_id")))
    first = shares.select(F.col("company_id").alias("_one"), "market", F.col("share").alias("_s1"))
    second = shares.select(F.col("company_id").alias("_two"), "market", F.col("share").alias("_s2"))
    j = p.join(first, "_one").join(second, ["_two", "market"]).join(market_hhi(shares), "market")
    j = j.withColumn("buyer_share", F.when(few, F.col("_s1")).otherwise(F.col("_s2"))).withColumn("target_share", F.when(few, F.col("_s2")).otherwise(F.col("_s1")))
    j = j.drop("_one", "_two", "_s1", "_s2", "_buyer", "_target")
    j = j.withColumn("delta", F.col("buyer_share") * F.col("target_share") * 2)
    return j.withColumn("post_hhi", F.col("hhi") + F.col("delta")).withColumn("band", concentration_band(F.col("post_hhi")))


def antitrust_risk(merged: DataFrame, reviews: DataFrame) -> DataFrame:
    """Five sub-risks per proposed pair and market, total, level, timeline and remedies."""
    d = merged.join(reviews, "acquirer_id", "left")
    a, t, delta, post = F.col("buyer_share"), F.col("target_share"), F.col("delta"), F.col("post_hhi")
    share = at_least(a + t, SHARE_RISK, 10) + points((a >= 25) & (t >= 5), 20)
    share = tidy(F.least(share * F.when(a < 5, 0.5).otherwise(1.0), F.lit(100.0)))
    hhi = first_match([((post > 2500) & (delta > 100), 90), (post > 2500, 60), ((post > 1500) & (delta > 200), 70), (post > 1500, 40)], 20)
    hhi = tidy(F.least(hhi + above(delta, [(400, 10), (200, 5)], 0), F.lit(100)))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: F.coalesce(F.try_divide(z(c), z("reviewed")), F.lit(0.0))
    past = (20 + z("challenges") * 15 + above(rate("blocked"), [(0.3, 30), (0.1, 15)], 0) + above(rate("remedies"), [(0.5, 20), (0.25, 10)], 0)
            + points(rate("second_requests") > 0.5, 15) + points(F.coalesce("decree", F.lit(False)), 25))
    past = tidy(F.least(past, F.lit(100)))
    n = F.col("overlap_areas")
    overlap = F.when(n > 0, F.least(50 + at_least(n, [(3, 30), (2, 20), (1, 10)], 0), F.lit(100)).cast("double")).otherwise(F.lit(10.0))
    size = at_least(F.col("deal_value_mm"), SIZE_RISK, 10.0)
    d = (d.withColumn("share_risk", share).withColumn("hhi_risk", hhi).withColumn("history_risk", past)
         .withColumn("overlap_risk", overlap).withColumn("size_risk", size))
    base = (F.col("share_risk") * 0.35 + F.col("hhi_risk") * 0.30 + F.col("history_risk") * 0.20 + F.col("overlap_risk") * 0.10
            + F.col("size_risk") * 0.05)
    d = d.withColumn("total_risk", tidy(F.least(base * CLIMATE, F.lit(100.0))))
    risk = F.col("total_risk")
    for i, name in enumerate(("outcome", "timeline", "second_request_p", "remedy_p")):
        d = d.withColumn(name, at_least(risk, [(r[0], r[i + 1]) for r in REVIEW], REVIEW_MIN[i]))
    remedies = F.array(F.when((risk >= 60) & (a > 25), "divest"), F.when((risk >= 60) & (F.col("overlap_risk") > 50), "license"),
                       F.when((risk >= 60) & (delta > 200), "joint_venture"))
    return d.withColumn("risk_level", at_least(risk, RISK_LEVELS, "minimal")).withColumn("remedies", F.filter(remedies, lambda x: x.isNotNull()))


def clinical_differentiation(drugs: DataFrame, strict: bool = False) -> DataFrame:
    """Dosing, novelty, efficacy, safety, total and rank share inside the class.

    The lowest safety bands test > 10 before > 20 (and > 20 before > 30), so the
    harsher cut never applies; ``strict=True`` orders them properly.
    """
    c = F.col
    dosing = (lookup(c("dosing"), DOSING, 50) * lookup(c("route"), ROUTE, 1.0) + points(c("new_formulation"), 10) + points(c("new_delivery"), 15)
              + points(c("formulation_patent"), 10) + F.coalesce(c("patient_pref") / 10 * 15, F.lit(0.0)))
    nov = c("novelty")
    edge = F.when(truthy(c("efficacy_delta")), above(c("efficacy_delta"), [(30, 20), (15, 12), (5, 6)], 0)).otherwise(0)
    moa = lookup(nov, NOVELTY, 50) + F.when(nov == "best_in_class", points(c("superior"), 15) + edge).when(
        nov == "fast_follower", points(c("new_formulation") | c("new_delivery"), 15) + points(c("superior"), 10)).otherwise(0)
    sig = F.when(truthy(c("p_value")), below(c("p_value"), [(0.001, 20), (0.01, 15), (0.05, 10)], 0)).otherwise(0)
    weight = F.when(F.lower("indication").isin("obesity", "weight loss"), at_least(c("endpoint_value"), [(20, 15), (15, 10), (10, 5)], 0)).otherwise(0)
    eff = 40 + sig + at_least(c("effect"), [(1.0, 25), (0.8, 20), (0.5, 12), (0.2, 6)], 0) + points(c("head_to_head"), 10) \
        + points(c("head_to_head") & c("superior"), 20) + weight
    efficacy = F.when(c("endpoint_met"), tidy(F.least(eff, F.lit(100)))).otherwise(F.lit(0.0))
    ae = F.when(c("ae_rate").isNotNull(), below(c("ae_rate"), [(20, 15), (40, 8), (60, 0), (80, -15)], -30)).otherwise(0)

    def tail(x: Column, good, mild: tuple, harsh: tuple) -> Column:
        bad = [harsh, mild] if strict else [mild, harsh]
        return first_match([(x < b, v) for b, v in good] + [(x > b, v) for b, v in bad], 0)

    safety = (70 + ae + tail(c("serious_rate"), [(2, 10), (5, 5)], (10, -20), (20, -40)) + tail(c("stop_rate"), [(5, 10), (10, 5)], (20, -15), (30, -30))
              + F.when(truthy(c("physician_pref")), (c("physician_pref") - 5) * 2).otherwise(0.0))
    d = (drugs.withColumn("dosing_score", tidy(F.least(dosing, F.lit(100.0)))).withColumn("novelty_score", tidy(F.least(moa, F.lit(100))))
         .withColumn("efficacy_score", efficacy).withColumn("safety_score", tidy(clamp(safety, 0.0, 100.0))))
    return d.withColumn("differentiation", tidy(c("dosing_score") * 0.30 + c("novelty_score") * 0.25 + c("efficacy_score") * 0.30 + c("safety_score") * 0.15))


def rank_in_class(scored: DataFrame, by: str = "drug_class", score: str = "differentiation", out: str = "class_rank") -> DataFrame:
    """Percent rank inside the class from a (class, score) histogram, so a large class is never one task's rows."""
    hist = scored.groupBy(by, score).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(by).orderBy(score)
    lower = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy(by))
    pr = F.when(total > 1, lower / (total - 1)).otherwise(F.lit(0.0))
    return join_on(scored, hist.select(by, score, pr.alias(out)), [by, score])


def premium_estimate(inputs: DataFrame) -> DataFrame:
    """Base, tension range, scarcity, antitrust and stage steps, each rounded to 0.1."""
    c, one = F.col, lambda x: tidy(x, 1)
    v = c("clinical") * 0.4 + c("momentum") * 0.35 + c("gap_fit") * 0.25
    base = first_match([(v >= 80, 70 + (v - 80) * 1.5), (v >= 60, 45 + (v - 60) * 1.25), (v >= 40, 25 + (v - 40) * 1.0), (v >= 20, 10 + (v - 20) * 0.75)], v * 0.5)
    d = inputs.withColumn("base", one(base))
    scarcity = at_least(c("clinical") * 0.6 + c("momentum") * 0.4, SCARCITY_ADD, 0.0)
    cut = at_least(c("antitrust"), ANTITRUST_CUT, 0.0)
    st = F.lower("stage")
    has = lambda *w: [st.contains(x) for x in w]
    any_of = lambda *w: F.array_max(F.array(*has(*w)))
    mult = first_match([(any_of("approved", "marketed"), 1.2), (any_of("nda", "bla", "phase 3"), 1.15), (st.contains("phase 2"), 1.0), (st.contains("phase 1"), 0.85)], 0.7)
    for i, side in enumerate(("low", "high")):
        d = d.withColumn(side, one(c("base") * at_least(c("tension"), [(r[0], r[i + 1]) for r in TENSION_RANGE], TENSION_MIN[i])))
        d = d.withColumn(side, one(c(side) + c(side) * scarcity))
        d = d.withColumn(side, one(c(side) * (F.lit(1.0) - cut)))
        d = d.withColumn(side, one(c(side) * mult))
    d = d.withColumn("mid", (c("low") + c("high")) / 2)
    conf = (F.lit(0.5) + points((c("tension") >= 80) | (c("tension") <= 30), 0.15) + points((c("clinical") >= 85) | (c("clinical") <= 20), 0.15)
            + points((c("momentum") >= 85) | (c("momentum") <= 25), 0.1) + points((c("antitrust") >= 75) | (c("antitrust") <= 25), 0.1))
    drivers = F.array(F.when(c("tension") >= 80, "tension"), F.when(c("clinical") >= 80, "differentiation"), F.when(c("momentum") >= 85, "hot_area"),
                      F.when(c("gap_fit") >= 80, "gap_fit"), F.when(c("antitrust") <= 30, "low_antitrust"), F.when(any_of("phase 3", "nda"), "late_stage"))
    rich = F.when(c("cash_mm") > 0, F.coalesce(F.try_divide(c("cash_mm"), c("cap_mm")) > 0.6, F.lit(False))).otherwise(F.lit(False))
    risks = F.array(F.when(c("tension") <= 40, "few_bidders"), F.when(c("clinical") <= 50, "weak_differentiation"), F.when(c("momentum") <= 40, "cool_market"),
                    F.when(c("antitrust") >= 60, "antitrust"), F.when(c("gap_fit") <= 50, "unclear_fit"), F.when(any_of("preclinical", "phase 1"), "early_stage"),
                    F.when(rich, "cash_rich"))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    ev = c("cap_mm") - c("cash_mm") * 0.5
    d = (d.withColumn("tier", at_least(c("mid"), PREMIUM_TIER, "discount")).withColumn("confidence", tidy(F.least(conf, F.lit(1.0))))
         .withColumn("drivers", some(drivers)).withColumn("risks", some(risks)))
    for side in ("low", "mid", "high"):
        d = d.withColumn(f"value_{side}", one(ev * (1 + one(c(side)) / 100)))
    return d.withColumn("premium", one(c("mid")))
