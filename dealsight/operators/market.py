"""Deal comparables, area momentum, market signals, sentiment and series detectors."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.bands import above, at_least, clamp, first_match, lookup, points, tidy
from dealsight.functions.clock import at, micros_between, whole_days
from dealsight.functions.scale import cut, exact_quantiles, latest_per_key, previous_values, sliced

# ---- fixed values -----------------------------------------------------------
AREA_BASELINE = {"obesity_metabolic": 95, "oncology_adc": 88, "radiopharmaceuticals": 82, "autoimmune": 78,
                 "rna_therapeutics": 75, "gene_therapy": 72, "oncology": 70, "rare_disease": 68, "cell_therapy": 65,
                 "neurology": 62, "cardiovascular": 55, "infectious_disease": 50}
DEAL_COUNT = [(10, 100), (7, 85), (5, 70), (3, 55)]
DEAL_VALUE = [(20, 100), (10, 85), (5, 70), (2, 55)]
ROUND_COUNT = [(20, 100), (15, 85), (10, 70), (5, 55)]
ROUND_VALUE = [(5, 100), (3, 85), (1.5, 70), (0.75, 55)]
TRIAL_COUNT = [(100, 100), (75, 85), (50, 70), (25, 55)]
MENTION_COUNT = [(50, 100), (30, 85), (20, 70), (10, 55), (5, 40)]
MOMENTUM_LEVEL = [(90, "extreme_hot"), (80, "very_hot"), (70, "hot"), (60, "warm"), (40, "neutral"), (20, "cool")]
NO_ROWS = 20.0
MA_LIKELIHOOD = [(80, "Very High", 0.85), (70, "High", 0.7), (60, "Moderate-High", 0.55), (50, "Moderate", 0.4), (40, "Low-Moderate", 0.3)]
PRESENTATION_WEIGHT = {"keynote": 2.0, "oral": 1.5, "panel": 1.2, "poster": 0.8}
QUALITY_FACTOR = {"breakthrough": 2.0, "positive": 1.5, "neutral": 1.0, "disappointing": 0.5}
SENTIMENT_WEIGHT = {"news": 0.35, "conference": 0.25, "social": 0.20, "analyst": 0.20}
POLARITY = [(0.6, "very_positive"), (0.2, "positive"), (-0.2, "neutral"), (-0.6, "negative")]
# keywords are lower-cased text fragments; two entries keep capitals and so never match lower-cased text
POSITIVE_WORDS = ["breakthrough", "positive", "success", "approval", "advance", "promising", "effective", "milestone",
                  "partnership", "acquisition", "beat", "exceed", "strong", "growth", "innovative", "FDA approval",
                  "clinical success", "expansion", "outperform", "bullish"]
NEGATIVE_WORDS = ["failure", "disappointing", "decline", "risk", "concern", "miss", "delay", "setback", "warning",
                  "investigation", "lawsuit", "rejected", "terminated", "bearish", "downgrade", "loss", "weak", "struggle",
                  "challenge", "adverse"]
DEAL_WORDS = ["acquisition", "merger", "buyout", "takeover", "deal", "offer", "bid", "acquire", "purchase", "M&A"]
STATUS_CHANGES = {("RECRUITING", "COMPLETED"): "trial_completed", ("ACTIVE_NOT_RECRUITING", "COMPLETED"): "trial_completed",
                  ("RECRUITING", "TERMINATED"): "trial_terminated", ("ACTIVE_NOT_RECRUITING", "TERMINATED"): "trial_terminated",
                  ("RECRUITING", "SUSPENDED"): "trial_suspended", ("NOT_YET_RECRUITING", "RECRUITING"): "trial_started",
                  ("RECRUITING", "WITHDRAWN"): "trial_withdrawn"}


# ---- comparables --------------------------------------------------------------

def comparable_deals(deals: DataFrame, as_of, area: str | None = None, stage: str | None = None, min_value: float | None = None,
                     max_value: float | None = None, years: int = 3) -> DataFrame:
    """Deals of the lookback window under optional filters."""
    d = deals.filter(F.col("deal_date") >= F.add_months(at(as_of), -12 * years))
    if area:
        d = d.filter(F.col("area") == area)
    if stage:
        d = d.filter(F.col("stage") == stage)
    if min_value is not None:
        d = d.filter(F.col("deal_value") >= min_value)
    return d if max_value is None else d.filter(F.col("deal_value") <= max_value)


def implied_valuation(requests: DataFrame, deals: DataFrame, as_of, years: int = 3) -> DataFrame:
    """Requests (area, stage, peak_sales) -> value range from area+stage, else area, else stage deals (>= 3 rows).

    Each grain is one aggregate over the deals; requests join three small tables.
    """
    d = comparable_deals(deals, as_of, years=years).withColumn("multiple", F.try_divide(F.col("deal_value"), F.col("target_market_cap")))
    grains = {"b": ["area", "stage"], "a": ["area"], "s": ["stage"]}
    # one row for each deal, grain and measure: all medians come from one sketch and one selection
    parts = [F.struct(F.lit(p).alias("_g"), F.lit(m).alias("_m"), *[(F.col(c) if c in keys else F.lit(None).cast("string")).alias(f"_{c}") for c in ("area", "stage")],
                      F.col(c).cast("double").alias("_x")) for p, keys in grains.items() for m, c in (("med", "deal_value"), ("mmed", "multiple"))]
    groups = ["_g", "_m", "_area", "_stage"]
    medians = cut(exact_quantiles(d.select("deal_id", F.inline(F.array(*parts))), groups, "_x", "deal_id", {"_q": 0.5}))

    def grain(keys: Sequence[str], p: str) -> DataFrame:
        keys = list(keys)
        a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.min("deal_value").alias(f"{p}_low"), F.max("deal_value").alias(f"{p}_high"),
                                 F.min("multiple").alias(f"{p}_mlow"), F.max("multiple").alias(f"{p}_mhigh"))
        for m in ("med", "mmed"):
            own = medians.where((F.col("_g") == p) & (F.col("_m") == m)).select(*[F.col(f"_{k}").alias(k) for k in keys], F.col("_q").alias(f"{p}_{m}"))
            a = a.join(own, keys)
        return a

    j = (requests.join(grain(["area", "stage"], "b"), ["area", "stage"], "left").join(grain(["area"], "a"), ["area"], "left")
         .join(grain(["stage"], "s"), ["stage"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    use = F.when(zero("b_n") >= 3, "b").when(zero("a_n") >= 3, "a").otherwise("s")
    pick = lambda c: F.when(use == "b", F.col(f"b_{c}")).when(use == "a", F.col(f"a_{c}")).otherwise(F.col(f"s_{c}"))
    peak = F.coalesce("peak_sales", F.lit(0.0))
    j = j.withColumn("n", F.coalesce(pick("n"), F.lit(0)))
    by_sales = (peak > 0) & pick("mmed").isNotNull()
    for name, col, mult, dflt in (("low", "low", "mlow", 0.5e9), ("median", "med", "mmed", 2.0e9), ("high", "high", "mhigh", 5.0e9)):
        j = j.withColumn(name, F.when(F.col("n") == 0, F.lit(dflt)).when(by_sales, peak * pick(mult)).otherwise(pick(col)))
    conf = F.when(F.col("n") == 0, "low").when((F.col("n") >= 5) & (peak > 0), "high").when(F.col("n") >= 3, "medium").otherwise("low")
    how = F.when(F.col("n") == 0, "insufficient_comparables").when(by_sales, "ev_peak_sales_multiple").otherwise("comparable_deal_values")
    return j.select(*requests.columns, "n", "low", "median", "high", conf.alias("confidence"), how.alias("methodology"))


def premium_quantiles(deals: DataFrame, by: Sequence[str] = ("area",)) -> DataFrame:
    """Premium spread with exclusive quartiles; zero and NULL premiums are left out."""
    d = deals.filter(F.coalesce("premium", F.lit(0)) != 0)
    q = exact_quantiles(d, list(by), "premium", "deal_id", {"p25": 0.25, "median": 0.5, "p75": 0.75}, exclusive=("p25", "p75"))
    mm = d.groupBy(*by).agg(F.min("premium").alias("min"), F.max("premium").alias("max"))
    if not by:
        return q.withColumn("_one", F.lit(1)).join(F.broadcast(mm.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return q.join(mm, list(by))


def structure_mix(deals: DataFrame) -> DataFrame:
    """Percent of deals by structure (counts first, then the total over the few groups)."""
    g = deals.groupBy("structure").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))) * 100)


def upfront_ratio(deals: DataFrame, by: Sequence[str] = (), default: float = 80.0) -> DataFrame:
    """Mean of upfront / total in percent."""
    ratio = F.when(F.col("deal_value") == 0, F.lit(0.0)).otherwise(F.col("upfront") / F.col("deal_value") * 100)
    return deals.groupBy(*by).agg(F.coalesce(F.avg(ratio), F.lit(default)).alias("upfront_ratio"))


def hot_areas(deals: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Count and value per area over the last months."""
    d = deals.filter(F.col("deal_date") >= F.add_months(at(as_of), -months))
    return d.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("deal_value").cast("decimal(24,2)")).cast("double").alias("total_value"))


# ---- area momentum --------------------------------------------------------------

def _since(as_of, days: int) -> Column:
    return at(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def _fill(areas: DataFrame, scored: DataFrame, out: str) -> DataFrame:
    return areas.select("area").join(scored, "area", "left").withColumn(out, F.coalesce(out, F.lit(NO_ROWS)))


def deal_volume_score(areas: DataFrame, deals: DataFrame, as_of, months: int = 24) -> DataFrame:
    """D12; deal_value_mm in millions."""
    recent = F.col("deal_date") >= _since(as_of, 180)
    v = F.col("deal_value_mm")
    g = deals.filter(F.col("deal_date") >= _since(as_of, 30 * months)).groupBy("area").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(v.cast("decimal(24,6)")).cast("double").alias("_v"), F.count_if(recent).alias("_r"), F.count_if(v > 5000).alias("_m"))
    score = (at_least(F.col("_n"), DEAL_COUNT, 40) * 0.4 + at_least(F.coalesce("_v", F.lit(0.0)) / 1000, DEAL_VALUE, 40) * 0.4
             + above(F.col("_r") / F.col("_n"), [(0.6, 15), (0.4, 8)], 0) + F.least(F.col("_m") * 10, F.lit(20)))
    return _fill(areas, g.select("area", tidy(F.least(score, F.lit(100.0))).alias("deal_score")), "deal_score")


def round_score(areas: DataFrame, rounds: DataFrame, as_of, months: int = 24) -> DataFrame:
    """D13; amount in millions."""
    recent = F.col("invested_on") >= _since(as_of, 180)
    g = rounds.filter(F.col("invested_on") >= _since(as_of, 30 * months)).groupBy("area").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("amount").cast("decimal(24,6)")).cast("double").alias("_v"),
        F.count_if(recent).alias("_r"), F.count_if(F.col("amount") > 100).alias("_l"))
    score = (at_least(F.col("_v") / 1000, ROUND_VALUE, 40) * 0.5 + at_least(F.col("_n"), ROUND_COUNT, 40) * 0.3
             + F.least(F.col("_l") * 8, F.lit(20)) + points(F.col("_r") / F.col("_n") > 0.5, 10))
    return _fill(areas, g.select("area", tidy(F.least(score, F.lit(100.0))).alias("round_score")), "round_score")


def trial_score(areas: DataFrame, trials: DataFrame, as_of, months: int = 24) -> DataFrame:
    """D14."""
    g = trials.filter(F.col("start_date") >= _since(as_of, 30 * months)).groupBy("area").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("phase").isin("Phase 2", "Phase 3")).alias("_late"),
        F.count_distinct("sponsor").alias("_s"), F.count_if(F.col("enrollment") > 500).alias("_big"))
    score = (at_least(F.col("_n"), TRIAL_COUNT, 40) * 0.6 + F.least(F.col("_late") * 2, F.lit(20))
             + F.least(F.col("_s") * 1.5, F.lit(15.0)) * 0.5 + F.least(F.col("_big") * 3, F.lit(15)) * 0.5)
    return _fill(areas, g.select("area", tidy(F.least(score, F.lit(100.0))).alias("trial_score")), "trial_score")


def keyword_mentions(docs: DataFrame, words: Mapping[str, str], text: str = "text") -> DataFrame:
    """Occurrences of each area's keyword over whole texts: one pass, one column per area, then a small unpivot."""
    low = F.lower(F.col(text))
    hits = [F.coalesce(F.sum(((F.length(low) - F.length(F.replace(low, F.lit(w.lower())))) / len(w)).cast("bigint")), F.lit(0)).alias(a)
            for a, w in words.items()]
    return docs.agg(*hits).unpivot([], list(words), "area", "mentions")


def mention_score(areas: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """Banded mentions; the area baseline when no feed is supplied."""
    if mentions is None:
        return areas.select("area", lookup(F.col("area"), AREA_BASELINE, 50.0).cast("double").alias("mention_score"))
    d = areas.select("area").join(mentions, "area", "left")
    return d.select("area", at_least(F.coalesce("mentions", F.lit(0)), MENTION_COUNT, 25).cast("double").alias("mention_score"))


def momentum_score(areas: DataFrame, as_of, deals=None, rounds=None, trials=None, mentions=None, months: int = 24) -> DataFrame:
    """Weighted blend; an absent feed scores the area baseline."""
    base = lambda out: areas.select("area", lookup(F.col("area"), AREA_BASELINE, 50.0).cast("double").alias(out))
    d = deal_volume_score(areas, deals, as_of, months) if deals is not None else base("deal_score")
    v = round_score(areas, rounds, as_of, months) if rounds is not None else base("round_score")
    t = trial_score(areas, trials, as_of, months) if trials is not None else base("trial_score")
    j = d.join(v, "area").join(t, "area").join(mention_score(areas, mentions), "area")
    total = F.col("deal_score") * 0.35 + F.col("round_score") * 0.25 + F.col("trial_score") * 0.20 + F.col("mention_score") * 0.20
    return j.withColumn("momentum", tidy(total)).withColumn("level", at_least(F.col("momentum"), MOMENTUM_LEVEL, "cold"))


def hot_sectors(areas: DataFrame, min_score: float = 70.0) -> DataFrame:
    """Areas whose standing score reaches the minimum, best first."""
    d = areas.select("area", lookup(F.col("area"), AREA_BASELINE, 50).cast("double").alias("score"))
    return d.filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), "area")


# ---- market signals -----------------------------------------------------------------

def market_score() -> Column:
    c = F.col
    s = (50 + at_least(c("volume_anomaly"), [(3, 20), (2, 15), (1.5, 10)], 0) + points(c("options_activity") == "heavy_call_buying", 15)
         + at_least(c("call_put"), [(2, 5), (1.5, 3)], 0) + F.least(c("accumulation") * 2, F.lit(15.0)) + F.least(c("insider") * 1.5, F.lit(10.0))
         + F.least((c("upgrades") - c("downgrades")) * 3, F.lit(10)) + F.least(c("target_change") / 5, F.lit(5.0))
         + first_match([(c("short_change") <= -20, 10), (c("short_change") <= -10, 5)], 0)
         + points(c("momentum_20d") >= 20, 5) + points(c("momentum_60d") >= 30, 5))
    return clamp(s, 0.0, 100.0)


def market_signal_score(market: DataFrame) -> DataFrame:
    """Composite and likelihood on the newest row per ticker."""
    d = latest_per_key(market, ["ticker"], ["ts", "signal_id"]).withColumn("composite", F.round(market_score(), 9))
    return (d.withColumn("likelihood", at_least(F.col("composite"), [(b, x) for b, x, _ in MA_LIKELIHOOD], "Low"))
            .withColumn("probability", at_least(F.col("composite"), [(b, y) for b, _, y in MA_LIKELIHOOD], 0.2)))


def anomaly_scan(market: DataFrame, watchlist: DataFrame, min_volume: float = 2.0, min_insider: float = 5.0) -> DataFrame:
    """Watched tickers whose newest row breaks a rule, with the reasons."""
    d = market_signal_score(market.join(watchlist.select("ticker").distinct(), "ticker", "left_semi"))
    c = F.col
    reasons = F.filter(F.array(
        F.when(c("volume_anomaly") >= min_volume, "volume spike"), F.when(c("insider") >= min_insider, "insider buying"),
        F.when(c("options_activity").isin("heavy_call_buying", "unusual_activity"), F.concat(F.lit("options: "), c("options_activity"))),
        F.when(c("accumulation") >= 5, "accumulation"), F.when(c("upgrades") >= 3, "upgrades")), lambda x: x.isNotNull())
    return d.withColumn("reasons", F.concat_ws("; ", reasons)).filter("reasons <> ''").orderBy(c("composite").desc(), "ticker")


# ---- sentiment ------------------------------------------------------------------------

def _weighted_mean(value: Column, weight: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def news_sentiment(news: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Relevance and recency weighted mean per ticker."""
    d = news.filter(F.col("published") >= _since(as_of, days))
    w = F.col("relevance") * F.greatest(F.lit(0.1), 1 - whole_days(F.col("published"), at(as_of)) / days)
    return d.groupBy("ticker").agg(_weighted_mean(F.col("sentiment"), w).alias("news_sentiment"), F.count(F.lit(1)).alias("articles"))


def conference_buzz(conf: DataFrame, as_of, days: int = 180) -> DataFrame:
    """Mean buzz x presentation weight x quality factor, at most 10."""
    d = conf.filter(F.col("held") >= _since(as_of, days))
    v = F.col("buzz") * lookup(F.col("presentation"), PRESENTATION_WEIGHT, 1.0) * lookup(F.col("quality"), QUALITY_FACTOR, 1.0)
    return d.groupBy("ticker").agg(F.least(F.avg(v), F.lit(10.0)).alias("buzz"), F.count(F.lit(1)).alias("talks"))


def social_momentum(social: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Hour-decayed engagement-weighted mean; trending rows weigh 1.5."""
    d = social.filter(F.col("ts") >= _since(as_of, days))
    hours = micros_between(F.col("ts"), at(as_of)) / 3_600_000_000
    w = F.col("engagement") * F.greatest(F.lit(0.1), 1 - hours / (days * 24)) * F.when(F.col("trending"), 1.5).otherwise(1.0)
    return d.groupBy("ticker").agg(_weighted_mean(F.col("sentiment"), w).alias("social_sentiment"), F.sum("mentions").alias("mentions"))


def aggregate_sentiment(news: DataFrame, conf: DataFrame, social: DataFrame, analyst: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Confidence-weighted blend of the four feeds; ``analyst`` is (ticker, analyst_sentiment)."""
    j = (news_sentiment(news, as_of, days).join(conference_buzz(conf, as_of), "ticker", "full_outer")
         .join(social_momentum(social, as_of), "ticker", "full_outer").join(analyst, "ticker", "full_outer"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    conf_s = (z("buzz") - 5.0) / 5.0
    parts = [(z("news_sentiment"), F.least(F.lit(1.0), z("articles") / 20), 0.35), (conf_s, F.least(F.lit(1.0), z("talks") / 3), 0.25),
             (z("social_sentiment"), F.least(F.lit(1.0), z("mentions") / 100), 0.20), (z("analyst_sentiment"), F.lit(0.5), 0.20)]
    num, den = F.lit(0.0), F.lit(0.0)
    for s, c, w in parts:
        num, den = num + s * c * w, den + c * w
    d = j.withColumn("aggregate", F.coalesce(F.try_divide(num, den), F.lit(0.0)))
    d = d.withColumn("confidence", sum((c for _, c, _ in parts), F.lit(0.0)) / 4)
    return d.withColumn("polarity", at_least(F.round("aggregate", 9), POLARITY, "very_negative"))


def sentiment_shift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change against the previous window with its label."""
    j = current.select("ticker", "aggregate").join(previous.select("ticker", F.col("aggregate").alias("before")), "ticker", "left")
    ch = F.round(F.col("aggregate") - F.coalesce("before", F.lit(0.0)), 9)
    lab = F.when(F.abs(ch) >= 0.5, F.when(ch > 0, "significantly improved").otherwise("significantly deteriorated")).when(
        F.abs(ch) >= 0.3, F.when(ch > 0, "moderately improved").otherwise("moderately declined")).otherwise("stable")
    return j.withColumn("change", ch).withColumn("shift", lab)


def count_present(text: Column, words: Sequence[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def text_sentiment(docs: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
                   deal_words: Sequence[str] = DEAL_WORDS, text: str = "text") -> DataFrame:
    """Lexicon score by distinct keyword presence and a deal-mention flag."""
    d = docs.withColumn("_low", F.lower(F.col(text)))
    d = d.withColumn("n_pos", count_present(F.col("_low"), positive)).withColumn("n_neg", count_present(F.col("_low"), negative))
    s = F.coalesce(F.try_divide(F.col("n_pos") - F.col("n_neg"), F.col("n_pos") + F.col("n_neg")), F.lit(0.0))
    return d.withColumn("sentiment", s).withColumn("mentions_deal", count_present(F.col("_low"), deal_words) > 0).drop("_low")


# ---- series detectors --------------------------------------------------------------------

def volume_zscore(prices: DataFrame, window: int = 30, threshold: float = 2.0, min_points: int = 5) -> DataFrame:
    """z of a day's volume against the trailing days (one row per symbol and day)."""
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(-window, -1)
    m, sd, k = F.avg("volume").over(w), F.stddev_samp("volume").over(w), F.count("volume").over(w)
    d = prices.withColumn("mean", m).withColumn("sd", sd).withColumn("_k", k)
    z = F.when((F.col("_k") >= min_points) & (F.col("sd") > 0), (F.col("volume") - F.col("mean")) / F.col("sd"))
    d = d.withColumn("z", z).filter(F.abs("z") > threshold).drop("_k")
    return d.withColumn("kind", F.when(F.col("z") > 0, "high_volume").otherwise("low_volume"))


def price_change_asof(prices: DataFrame, as_of, days: int = 30) -> DataFrame:
    """C17: newest close against the last close at least ``days`` old, else the oldest."""
    cut = F.date_sub(at(as_of).cast("date"), days)
    g = prices.groupBy("symbol").agg(
        F.max_by("close", "day").alias("current"), F.max_by(F.when(F.col("day") <= cut, F.col("close")), F.when(F.col("day") <= cut, F.col("day"))).alias("_asof"),
        F.min_by("close", "day").alias("_oldest"), F.count(F.lit(1)).alias("_n"))
    d = g.filter("_n >= 2 AND current <> 0").withColumn("previous", F.when(F.coalesce("_asof", F.lit(0.0)) != 0, F.col("_asof")).otherwise(F.col("_oldest")))
    d = d.filter("previous <> 0")
    return d.select("symbol", "current", "previous", tidy((F.col("current") - F.col("previous")) / F.col("previous") * 100).alias("change_pct"))


def status_changes(statuses: DataFrame, key: str = "trial_id") -> DataFrame:
    """the important status transitions of each trial."""
    d = previous_values(sliced(statuses, [key], ["ts", "event_id"]), [key], F.col("_slice"), ["ts", "event_id"], {"previous": "status"}).drop("_slice")
    label = first_match([((F.col("previous") == a) & (F.col("status") == b), v) for (a, b), v in STATUS_CHANGES.items()], None)
    return d.withColumn("change", label).filter("change IS NOT NULL")


def enrollment_changes(snapshots: DataFrame, key: str = "trial_id", min_pct: float = 10.0) -> DataFrame:
    """F8: change against the previous snapshot above ``min_pct``; a zero base is skipped."""
    d = previous_values(sliced(snapshots, [key], ["ts", "event_id"]), [key], F.col("_slice"), ["ts", "event_id"], {"previous": "enrollment"}).drop("_slice")
    pct = F.try_divide((F.col("enrollment") - F.col("previous")) * 100, F.col("previous"))
    return d.withColumn("change_pct", tidy(pct)).filter((F.abs(pct) > min_pct) & F.col("previous").isNotNull())


def enrollment_velocity(snapshots: DataFrame, key: str, period: str, value: Column) -> DataFrame:
    """amount per period and its change against the period before."""
    g = snapshots.groupBy(key, F.date_trunc(period, F.col("ts").cast("timestamp")).alias("period")).agg(F.sum(value).alias("amount"))
    prev = F.lag("amount").over(W.partitionBy(key).orderBy("period"))
    return g.withColumn("velocity_change", F.col("amount") - prev)


def price_moves(prices: DataFrame, sectors: DataFrame, min_move: float = 10.0) -> DataFrame:
    """moves over ``min_move`` percent and strength against the sector's mean move that day."""
    w = W.partitionBy("symbol").orderBy("day")
    d = prices.withColumn("move_pct", (F.col("close") / F.lag("close").over(w) - 1) * 100).join(sectors, "symbol")
    avg = d.groupBy("sector", "day").agg(F.avg("move_pct").alias("sector_move"))
    d = d.join(avg, ["sector", "day"])
    return d.withColumn("relative", F.col("move_pct") - F.col("sector_move")).filter(F.abs("move_pct") > min_move)
