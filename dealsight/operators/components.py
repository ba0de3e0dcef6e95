"""The six component scores, their weights and the composite score."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import above, at_least, below, clamp, first_match, lookup, points, tidy, truthy
from dealsight.functions.clock import DEFAULT_HALF_LIFE, at, decay_weight, whole_days
from dealsight.functions.scale import latest_per_key, top_per_key

# ---- fixed values -----------------------------------------------------------
PHASE_VALUE = {"preclinical": 0.3, "phase_1": 0.5, "phase_2": 0.8, "phase_3": 1.0, "nda_bla": 0.9, "approved": 0.7}
AREA_VALUE = {"oncology": 1.0, "rare_disease": 0.95, "immunology": 0.9, "neurology": 0.85, "metabolic": 0.8,
              "cardiovascular": 0.75, "infectious_disease": 0.7, "other": 0.5}
DESIGNATION_POINTS = {"breakthrough": 15, "orphan": 10, "fast_track": 8, "priority_review": 5}
ASSET_TOP_WEIGHTS = {1: [1.0], 2: [0.6, 0.4], 3: [0.5, 0.3, 0.2]}
PATENT_LIFE = [(0, 0), (3, 20), (8, 100), (15, 80)]
PATENT_LIFE_MAX = 60
PATENT_TOP_WEIGHTS = {1: [1.0], 2: [0.5, 0.3, 0.2], 4: [0.4, 0.3, 0.2, 0.1]}
RUNWAY_BAND = [(3, 100), (6, 90), (12, 80), (18, 60), (24, 40)]
CAP_BAND = [(1e8, 100), (3e8, 80), (5e8, 60), (1e9, 40), (2e9, 20)]
REVENUE_BAND = [(1e8, 20), (5e7, 15), (1e7, 10)]
PURCHASE_SIZE = [(1e6, 10), (5e5, 5), (1e5, 3)]
SALE_SIZE = [(5e6, 15), (1e6, 8), (5e5, 4)]
PATHWAY_BASE = {"505b2": 85, "bla": 80, "nda": 75, "orphan": 90, "breakthrough": 95, "fast_track": 85,
                "priority_review": 90, "unclear": 40, "none": 30}
HOLD_PENALTY, WARNING_PENALTY = 25, 15
DEFAULT_WEIGHTS = {"pipeline": (0.30, 60.0), "patent": (0.20, 90.0), "financial": (0.15, 14.0),
                   "insider": (0.15, 30.0), "strategic_fit": (0.10, 180.0), "regulatory": (0.10, 45.0)}


def weighted_top(df: DataFrame, key: str, score: str, sets: Mapping[int, Sequence[float]], counts: DataFrame | None = None) -> DataFrame:
    """Per key: weighted sum of its best scores and its row count.

    ``sets`` maps a minimum row count to the weight vector used from there on.
    Only the best few rows of a key cross the shuffle.  ``counts`` (key, n) is given where ``df`` holds only the best rows.
    """
    k = max(len(w) for w in sets.values())
    best = top_per_key(df.select(key, score), [key], [F.col(score).desc()], k, "_rk")
    if counts is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = best.join(counts, key)
    weight = F.lit(0.0)
    for minimum in sorted(sets):
        vec = sets[minimum]
        w = lookup(F.col("_rk"), {i + 1: v for i, v in enumerate(vec)}, 0.0)
        weight = F.when(F.col("n") >= minimum, w).otherwise(weight)
    return (joined.withColumn("_w", weight).groupBy(key)
            .agg(F.sum(F.col(score) * F.col("_w")).alias("base"), F.max("n").alias("n")))


def signal_decay(signals: DataFrame, as_of, half_life: Column | float, ts: str = "event_date",
                 score: str = "value") -> DataFrame:
    """Age in whole days, weight and decayed score of every signal."""
    days = whole_days(F.col(ts), at(as_of))
    return (signals.withColumn("age_days", days)
            .withColumn("weight", decay_weight(F.col("age_days"), half_life))
            .withColumn("decayed", F.col(score) * F.col("weight")))


def asset_scores(assets: DataFrame, as_of, half_life: float = DEFAULT_HALF_LIFE) -> DataFrame:
    """Score of each programme before it is rolled up."""
    pop, days = F.col("patient_population"), whole_days(F.col("last_update").cast("timestamp_ntz"), at(as_of))
    small = F.when(F.col("orphan"), F.lit(5)).otherwise(F.lit(-5))
    market = F.when(truthy(pop), first_match([(pop > 1_000_000, 15), (pop > 100_000, 10), (pop < 10_000, small)], 0))
    score = (lookup(F.col("phase"), PHASE_VALUE, 0.3) * 100 * lookup(F.col("area"), AREA_VALUE, 0.5)
             + F.coalesce(market, F.lit(0)))
    for flag, pts in DESIGNATION_POINTS.items():
        score = score + points(F.col(flag), pts)
    score = F.when(F.col("last_update").isNull(), score).otherwise(score * decay_weight(days, half_life))
    return assets.withColumn("asset_score", F.least(score, F.lit(100.0)))


def asset_component(assets: DataFrame, as_of, half_life: float = DEFAULT_HALF_LIFE) -> DataFrame:
    """Programme value per company from active assets."""
    scored = asset_scores(assets.filter("is_active"), as_of, half_life)
    base = weighted_top(scored, "company_id", "asset_score", ASSET_TOP_WEIGHTS)
    bonus = F.least(F.col("n") * 2, F.lit(15))
    return base.select("company_id", tidy(F.least(F.col("base") + bonus, F.lit(100.0))).alias("score"),
                       F.col("n").alias("signals"))


def patent_score(years: str) -> Column:
    """Score of one patent by the column of years it has left."""
    kind = first_match([(F.col("is_composition"), 1.5), (F.col("is_method"), 1.0), (F.col("is_formulation"), 0.8)], 1.0)
    score = (below(F.col(years), PATENT_LIFE, PATENT_LIFE_MAX) * kind + F.least(F.col("claims_count") * 2, F.lit(30))
             + F.least(F.col("citations_count") * 3, F.lit(20)))
    return F.least(score, F.lit(100.0))


def years_left(as_of) -> Column:
    return whole_days(at(as_of), F.col("expiry_date")) / 365.25


def patent_component(patents: DataFrame, as_of, key: str = "company_id") -> DataFrame:
    """Patent strength per portfolio from unexpired patents."""
    live = patents.filter(F.col("expiry_date") >= at(as_of)).withColumn("_years", years_left(as_of))
    return portfolio_scores(live.withColumn("patent_score", patent_score("_years")), key)


def portfolio_scores(scored: DataFrame, key: str = "company_id", counts: DataFrame | None = None) -> DataFrame:
    """E3 from the scores of each portfolio's patents; see ``weighted_top`` for ``counts``."""
    base = weighted_top(scored, key, "patent_score", PATENT_TOP_WEIGHTS, counts)
    bonus = F.least(F.col("n") * 3, F.lit(20))
    return base.select(key, tidy(F.least(F.col("base") + bonus, F.lit(100.0))).alias("score"),
                       F.col("n").alias("signals"))


def financial_component(financials: DataFrame, as_of) -> DataFrame:
    """Financing pressure and valuation on the newest row per company."""
    f = financial_scores(latest_per_key(financials, ["company_id"], ["as_of_date"]), as_of)
    return f.select("company_id", "score", "runway_months", "months_to_catalyst", F.col("as_of_date").alias("last_updated"))


def financial_scores(f: DataFrame, as_of) -> DataFrame:
    """E4's score of each row."""
    cap, burn = F.col("market_cap"), F.col("burn_rate")
    runway = F.when(burn > 0, F.col("cash") / burn).otherwise(F.lit(999.0))
    f = f.withColumn("runway_months", runway).withColumn(
        "months_to_catalyst", whole_days(at(as_of), F.col("next_catalyst_date")) / 30.4)
    run, m = F.col("runway_months"), F.col("months_to_catalyst")
    catalyst = first_match([((m > 0) & (m < run - 3), 10), ((m > 0) & (m < run + 3), 25), (m > run, 40)], 0)
    total = (below(run, RUNWAY_BAND, 20) * 0.4 + catalyst * 0.2 + below(cap, CAP_BAND, 10) * 0.3
             + above(F.col("revenue"), REVENUE_BAND, 0) * 0.1)
    return f.withColumn("score", F.when(cap > 0, tidy(F.least(total, F.lit(100.0)))).otherwise(F.lit(0.0)))


def insider_feed(transactions: DataFrame, holdings: DataFrame) -> DataFrame:
    """company_id, ts, points of every trade and holding change."""
    amt, ex = F.col("amount"), F.col("is_executive")
    buy = F.when(ex, 5).otherwise(3) + above(amt, PURCHASE_SIZE, 0)
    sell = -(F.when(ex, 3).otherwise(1) + above(amt, SALE_SIZE, 0))
    trade_points = first_match([(F.col("transaction_type") == "purchase", buy),
                                ((F.col("transaction_type") == "sale") & ~F.col("is_planned"), sell)], 0)
    trades = transactions.select("company_id", F.col("transaction_date").alias("ts"), trade_points.alias("points"))
    chg, act = F.col("position_change_pct"), F.col("is_activist")
    gain = F.when(act, 8).otherwise(4) + above(chg, [(50, 10), (20, 5)], 0)
    loss = -(F.when(act, 6).otherwise(3) + points(chg < -50, 8))
    moves = holdings.select("company_id", F.col("filing_date").alias("ts"), first_match([(chg > 0, gain), (chg < 0, loss)], 0).alias("points"))
    return trades.unionByName(moves)


def insider_component(transactions: DataFrame, holdings: DataFrame, as_of, lookback: str = "INTERVAL 1 YEAR",
                      half_life: float = DEFAULT_HALF_LIFE) -> DataFrame:
    """E5: 50 plus decayed signed points of trades and holding changes."""
    now = at(as_of)
    feed = insider_feed(transactions, holdings).filter(F.col("ts") >= now - F.expr(lookback))
    weight = decay_weight(whole_days(F.col("ts"), now), half_life)
    return (feed.groupBy("company_id")
            .agg(F.sum(F.col("points") * weight).alias("_p"), F.count(F.lit(1)).alias("signals"),
                 F.max("ts").alias("last_updated"))
            .select("company_id", tidy(clamp(F.col("_p") + 50, 0.0, 100.0)).alias("score"), "signals", "last_updated"))


def issue_counts(issues: DataFrame, as_of) -> DataFrame:
    """D3: holds and warning letters per company in the last two years."""
    return (issues.filter(F.col("issue_date") >= at(as_of) - F.expr("INTERVAL 2 YEARS")).groupBy("company_id")
            .agg(F.count_if(F.col("issue_type") == "clinical_hold").alias("clinical_holds"),
                 F.count_if(F.col("issue_type") == "warning_letter").alias("warning_letters")))


def talk_feed(interactions: DataFrame) -> DataFrame:
    """company_id, ts, points of every contact with a regulator."""
    out, kind = F.lower("outcome"), F.lower("interaction_type")
    good = out.contains("positive") | out.contains("agreement")
    pts = first_match([(good & kind.contains("spa"), 15), (good & kind.contains("meeting"), 10), (good, 5),
                       (out.contains("complete response"), -20)], 0)
    return interactions.select("company_id", F.col("interaction_date").alias("ts"), pts.alias("points"))


def regulatory_component(pathways: DataFrame, interactions: DataFrame, issues: DataFrame, as_of,
                         half_life: float = DEFAULT_HALF_LIFE) -> DataFrame:
    """Pathway base + decayed interaction points - penalties."""
    weight = decay_weight(whole_days(F.col("ts"), at(as_of)), half_life)
    talks = (talk_feed(interactions).filter(F.col("ts") >= at(as_of) - F.expr("INTERVAL 2 YEARS"))
             .groupBy("company_id")
             .agg(F.sum(F.col("points") * weight).alias("_talk"),
                  F.count(F.lit(1)).alias("signals"), F.max("ts").alias("last_updated")))
    return regulatory_scores(pathways, talks, issue_counts(issues, as_of))


def regulatory_scores(pathways: DataFrame, talks: DataFrame, issues: DataFrame, key: str = "company_id") -> DataFrame:
    """E6's score from each company's decayed points and counts of issues."""
    base = pathways.select(key, lookup(F.lower("regulatory_pathway"), PATHWAY_BASE, 50).alias("_base"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = (F.col("_base") + z("_talk") - z("clinical_holds") * HOLD_PENALTY - z("warning_letters") * WARNING_PENALTY)
    return (base.join(talks, key, "left").join(issues, key, "left")
            .select(key, tidy(clamp(total, 0.0, 100.0)).alias("score"), z("signals").alias("signals"),
                    "last_updated"))


def fit_score(areas: Column, buyer_areas: Column, gaps: Column, technology_fit: float = 0.5) -> Column:
    """Fit of one target with one buyer; 50 when either side has no areas."""
    overlap = F.size(F.array_intersect(areas, buyer_areas)) / F.size(areas) * 60
    hits = F.size(F.filter(F.coalesce(gaps, F.array().cast("array<string>")),
                           lambda g: F.exists(areas, lambda a: F.contains(F.lower(a), F.lower(g)))))
    fresh = F.size(F.array_except(areas, buyer_areas))
    total = (overlap * 0.4 + F.least(hits * 20, F.lit(40)) * 0.3 + F.lit(technology_fit * 30 * 0.2)
             + F.least(fresh * 10, F.lit(20)) * 0.1)
    known = (F.size(F.coalesce(areas, F.array().cast("array<string>"))) > 0) & (
        F.size(F.coalesce(buyer_areas, F.array().cast("array<string>"))) > 0)
    return F.when(known, tidy(F.least(total, F.lit(100.0)))).otherwise(F.lit(50.0))


def strategic_fit_component(companies: DataFrame, acquirers: DataFrame, top: int = 5) -> DataFrame:
    """Average fit with the largest active buyers (one array of ``top`` buyers)."""
    biggest = (acquirers.filter("is_active").orderBy(F.col("market_cap").desc(), "acquirer_id").limit(top)
               .agg(F.collect_list(F.struct("acquirer_id", "areas", "gaps")).alias("_buyers")).withColumn("_one", F.lit(1)))
    fits = F.transform("_buyers", lambda b: fit_score(F.col("areas"), b["areas"], b["gaps"]))
    mean = F.aggregate(fits, F.lit(0.0), lambda a, x: a + x) / F.size("_buyers")
    return (companies.withColumn("_one", F.lit(1)).join(F.broadcast(biggest), "_one")
            .select("company_id", F.when(F.size("_buyers") > 0, mean).otherwise(F.lit(50.0)).alias("score"),
                    F.size("_buyers").cast("bigint").alias("signals")))


def weights_table(spark, weights: Mapping[str, tuple[float, float]] = DEFAULT_WEIGHTS) -> DataFrame:
    return spark.createDataFrame([(c, w, True, h) for c, (w, h) in weights.items()],
                                 "component string, weight double, enabled boolean, half_life double")


def half_lives_of(weights: DataFrame) -> dict[str, float]:
    """The half-life of each enabled component that names one; one row a component."""
    return {r[0]: r[1] for r in weights.filter("enabled AND half_life > 0").select("component", "half_life").collect()}


def normalize_weights(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Enabled weights divided by their total (per ``by`` profile).

    A profile without positive enabled weight raises, as there is no score.
    """
    on = weights.filter("enabled")
    total = on.groupBy(*by).agg(F.sum("weight").alias("_total"))
    j = on.join(total, list(by)) if by else on.withColumn("_j", F.lit(1)).join(
        F.broadcast(total.withColumn("_j", F.lit(1))), "_j").drop("_j")
    ok = F.when(F.col("_total") == 0, F.raise_error(F.lit("enabled weights total zero")).cast("double"))
    return j.withColumn("weight", F.coalesce(ok, F.col("weight") / F.col("_total"))).drop("_total")


def composite_score(components: DataFrame, weights: DataFrame, as_of) -> DataFrame:
    """E9 + E10: composite, top-3 drivers and confidence from long component rows."""
    w = F.broadcast(normalize_weights(weights).select("component", "weight"))  # one row per component
    rows = components.join(w, "component").withColumn("contribution", F.col("score") * F.col("weight"))
    age = whole_days(F.col("last_updated"), at(as_of))
    recency = F.when(F.col("last_updated").isNotNull(), F.greatest(1 - age / 90, F.lit(0.0)))
    drivers = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("contribution", "component", "score")))), 1, 3)
    g = rows.groupBy("company_id").agg(
        F.sum("contribution").alias("_sum"), F.sum("signals").alias("_signals"), F.avg(recency).alias("_rec"),
        F.var_pop("score").alias("_var"), F.count(F.lit(1)).alias("_n"), drivers.alias("_top"))
    consistency = F.when(F.col("_n") > 1, F.greatest(1 - F.col("_var") / 1000, F.lit(0.0)) * 0.3).otherwise(F.lit(0.0))
    conf = F.least(F.col("_signals") / 50, F.lit(0.4)) + F.coalesce(F.col("_rec"), F.lit(0.0)) * 0.3 + consistency
    label = lambda d: F.when(d["score"] >= 70, F.concat(F.lit("Strong "), d["component"])).when(
        d["score"] >= 50, F.concat(F.lit("Moderate "), d["component"]))
    return g.select("company_id", tidy(clamp(F.col("_sum"), 0.0, 100.0)).alias("overall_score"),
                    tidy(clamp(conf, 0.1, 1.0)).alias("confidence"),
                    F.transform("_top", lambda d: d["component"]).alias("drivers"),
                    F.filter(F.transform("_top", label), lambda x: x.isNotNull()).alias("key_signals"))


def long_components(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Stack per-component results into (company_id, component, score, signals, last_updated)."""
    out = None
    for name, df in parts.items():
        have = set(df.columns)
        row = df.select("company_id", F.lit(name).alias("component"), F.col("score").cast("double").alias("score"),
                        (F.col("signals") if "signals" in have else F.lit(1)).cast("bigint").alias("signals"),
                        (F.col("last_updated") if "last_updated" in have else F.lit(None)).cast("timestamp_ntz").alias("last_updated"))
        out = row if out is None else out.unionByName(row)
    return out


def batch_scores(companies: DataFrame, assets: DataFrame, patents: DataFrame, financials: DataFrame,
                 transactions: DataFrame, holdings: DataFrame, pathways: DataFrame, interactions: DataFrame,
                 issues: DataFrame, acquirers: DataFrame, weights: DataFrame, as_of_deals, as_of_events,
                 half_lives: Mapping[str, float] | None = None) -> DataFrame:
    """Every component for the whole universe in one job; ids not in
    ``companies`` drop out, companies without rows in a feed score that feed's neutral value.

    ``half_lives`` gives components a half-life of their own (U1), see ``half_lives_of``; the others keep the common one.
    """
    own = lambda name: {"half_life": float(half_lives[name])} if half_lives and name in half_lives else {}
    parts = {
        "pipeline": (asset_component(assets, as_of_deals, **own("pipeline")), 0.0), "patent": (patent_component(patents, as_of_deals), 0.0),
        "financial": (financial_component(financials, as_of_deals).drop("last_updated"), 0.0), "insider": (insider_component(transactions, holdings, as_of_events, **own("insider")), 50.0),
        "strategic_fit": (strategic_fit_component(companies, acquirers), 50.0),
        "regulatory": (regulatory_component(pathways, interactions, issues, as_of_events, **own("regulatory")), 50.0),
    }
    return composite_score(complete_components(companies, parts), weights, as_of_events)


def complete_components(companies: DataFrame, parts: Mapping[str, tuple[DataFrame, float]]) -> DataFrame:
    """Long component rows with the neutral value of each feed for companies it does not know."""
    found = long_components({name: df for name, (df, _) in parts.items()})
    # one read of the companies, each with a neutral row per feed, meets the stacked results once
    neutral = F.array(*[F.struct(F.lit(name).alias("component"), F.lit(float(value)).alias("_score"),
                                 F.lit(0 if "signals" in df.columns else 1).cast("bigint").alias("_signals")) for name, (df, value) in parts.items()])
    rows = companies.select("company_id", F.inline(neutral)).join(found, ["company_id", "component"], "left")
    return rows.select("company_id", "component", F.coalesce("score", "_score").alias("score"), F.coalesce("signals", "_signals").alias("signals"), "last_updated")
