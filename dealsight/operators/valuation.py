"""Drug revenue curves, discounted cash flow, sensitivity, scenarios and portfolios.

Curve parameters are looked up once per drug, then a drug expands to its (few)
projection years and sums back.  All years of a drug sit in one partition, so the
sum combines before the shuffle and one row per drug crosses it.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import lookup
from dealsight.functions.scale import top_per_key

# ---- fixed values -----------------------------------------------------------
CURVES = {"standard": (5, 8, 0.3), "blockbuster": (4, 9, 0.25), "orphan": (3, 10, 0.5), "fast_follower": (3, 5, 0.2),
          "gene_therapy": (2, 10, 0.6)}  # ramp years, decline start, share kept after exclusivity ends
SUCCESS = {"Preclinical": 0.075, "Phase 1": 0.175, "Phase 2": 0.3, "Phase 3": 0.6, "NDA Filed": 0.9, "Approved": 1.0}
SUCCESS_MIN = {"Preclinical": 0.05, "Phase 1": 0.15, "Phase 2": 0.25, "Phase 3": 0.5, "NDA Filed": 0.85, "Approved": 1.0}
AREA_FACTOR = {"Oncology Solid Tumors": 0.85, "Oncology Hematology": 1.1, "Rare Disease": 1.15, "Obesity/Metabolic": 0.9, "CNS": 0.75,
               "Immunology": 1.05, "Cardiovascular": 0.95, "Infectious Disease": 1.0, "Respiratory": 0.95}
DISCOUNT = {"Preclinical": 0.18, "Phase 1": 0.15, "Phase 2": 0.15, "Phase 3": 0.12, "NDA Filed": 0.12, "Approved": 0.10}
BURN = {"Preclinical": 10e6, "Phase 1": 25e6, "Phase 2": 50e6, "Phase 3": 100e6, "NDA Filed": 30e6, "Approved": 0.0}
BURN_GROWTH = 1.05
COGS, RD, SGA, TAX, DEPRECIATION, CAPEX = 0.25, 0.20, 0.30, 0.15, 0.05, 0.05
DECLINE, EROSION, EROSION_YEARS = 0.15, 0.9, 3
PROJECTION_YEARS = 20
SHARE = {"first_in_class": 0.30, "best_in_class": 0.25, "competitive": 0.15, "me_too": 0.08, "orphan_dominant": 0.50}
LATE_SHARE_FACTOR = 0.75
MARKET = {"Oncology Solid Tumors": (20e9, 5e9, 500_000), "Oncology Hematology": (10e9, 3e9, 200_000), "Rare Disease": (1e9, 0.5e9, 20_000),
          "Obesity/Metabolic": (75e9, 50e9, 100_000_000), "CNS": (20e9, 10e9, 5_000_000), "Immunology": (35e9, 20e9, 10_000_000),
          "Cardiovascular": (30e9, 15e9, 20_000_000), "Infectious Disease": (12e9, 5e9, 3_000_000)}  # typical, low, patients
GRID = {"peak_sales": [0.5, 0.75, 1.0, 1.25, 1.5], "discount_rate": [0.08, 0.10, 0.12, 0.15, 0.18],
        "probability_of_success": [0.5, 0.75, 1.0, 1.25, 1.5], "time_to_peak": [3, 4, 5, 6, 7]}
CONTROL_PREMIUM = 0.4


def with_curve(drugs: DataFrame, curve: str = "curve") -> DataFrame:
    part = lambda i: lookup(F.col(curve), {k: v[i] for k, v in CURVES.items()}, CURVES["standard"][i])
    return drugs.withColumn("_ramp", part(0)).withColumn("_decline", part(1)).withColumn("_kept", part(2))


def year_revenue(year: Column, peak: Column, launch: Column, life: Column) -> Column:
    """Revenue of one projection year (0 before launch) from the curve columns.

    The curve follows its own ramp length; a drug's time_to_peak does not move it.
    """
    ramp, decline, kept = F.col("_ramp"), F.col("_decline"), F.col("_kept")
    y = year - launch
    rising = peak * (F.tanh(3 * (y / ramp - 0.5)) + 1) / 2
    falling = F.when(life > decline, peak * F.greatest(1 - DECLINE * (y - decline) / (life - decline), kept + 0.1)).otherwise(peak)
    after = peak * kept * F.when(y == life, F.lit(1.0)).otherwise(F.pow(F.lit(EROSION), F.least(y - life, F.lit(EROSION_YEARS))))
    return F.when(y < 0, F.lit(0.0)).when(y < ramp, rising).when(y < decline, peak).when(y < life, falling).otherwise(after)


CURVE_COLUMNS = ("_ramp", "_decline", "_kept")


def by_year(drugs: DataFrame, peak: str = "peak_sales", launch: str = "years_to_launch", n: int = PROJECTION_YEARS) -> DataFrame:
    d = with_curve(drugs).withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rev = year_revenue(F.col("year"), F.col(peak).cast("double"), F.col(launch), F.col("patent_life"))
    return d.withColumn("revenue", rev).drop(*CURVE_COLUMNS)


def revenue_projection(drugs: DataFrame, n: int = PROJECTION_YEARS) -> DataFrame:
    """One row per drug and year."""
    return by_year(drugs, n=n)


def success_rate(phase: str = "phase", area: str | None = "area", typical: bool = True) -> Column:
    p = lookup(F.col(phase), SUCCESS if typical else SUCCESS_MIN, None)
    return F.least(p * lookup(F.col(area), AREA_FACTOR, 1.0) if area else p, F.lit(1.0))


def with_assumptions(drugs: DataFrame) -> DataFrame:
    """Fill probability and discount rate from phase and area where a drug has none."""
    have = set(drugs.columns)
    p = F.coalesce("probability", success_rate()) if "probability" in have else success_rate()
    d = lookup(F.col("phase"), DISCOUNT, 0.10)
    return drugs.withColumn("probability", p).withColumn("discount_rate", F.coalesce("discount_rate", d) if "discount_rate" in have else d)


def cash_flow(year: Column, revenue: Column, launch: Column, phase: str = "phase", cogs=COGS, rd=RD, sga=SGA, tax=TAX) -> Column:
    """Development cost before launch; after it EBIT taxed only when positive."""
    ebit = revenue - revenue * cogs - revenue * rd - revenue * sga - revenue * DEPRECIATION
    net = ebit - F.when(ebit > 0, ebit * tax).otherwise(F.lit(0.0))
    cost = lookup(F.col(phase), BURN, 30e6) * F.pow(F.lit(BURN_GROWTH), year)
    return F.when(year < launch, -cost).otherwise(net + revenue * DEPRECIATION - revenue * CAPEX)


def with_npv(drugs: DataFrame, peak: str = "peak_sales", launch: str = "years_to_launch", rate: str = "discount_rate",
             n: int = PROJECTION_YEARS, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``npv_unadjusted``: discounted cash flow summed over the projection.

    ``keep`` names the columns to carry (they become grouping keys); all by default.
    """
    y = by_year(drugs, peak, launch, n)
    flow = cash_flow(F.col("year"), F.col("revenue"), F.col(launch)) / F.pow(1 + F.col(rate), F.col("year"))
    return y.groupBy(*(keep or drugs.columns)).agg(F.sum(flow).alias("npv_unadjusted"))


def dcf_npv(drugs: DataFrame, n: int = PROJECTION_YEARS) -> DataFrame:
    """Unadjusted and risk-adjusted net present value per drug."""
    d = with_npv(with_assumptions(drugs), n=n)
    return d.withColumn("npv_risk_adjusted", F.col("npv_unadjusted") * F.col("probability"))


def revenue_metrics(drugs: DataFrame, n: int = PROJECTION_YEARS, launch_probability: float = 1.0) -> DataFrame:
    """Total, peak, first peak year and mean of the (risk-scaled) projection."""
    peak, launch, life = F.col("peak_sales").cast("double"), F.col("years_to_launch"), F.col("patent_life")
    d = with_curve(drugs).withColumn("_rev", F.array(*[year_revenue(F.lit(y), peak, launch, life) * launch_probability for y in range(n)]))
    known = F.filter("_rev", lambda x: x.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    d = d.withColumn("total_revenue", total).withColumn("peak_revenue", F.array_max("_rev"))
    d = d.withColumn("years_to_peak", (F.array_position("_rev", F.col("peak_revenue")) - 1).cast("int"))
    return d.drop("_rev", *CURVE_COLUMNS).withColumn("average_revenue", F.col("total_revenue") / n)


def sensitivity_grid(drugs: DataFrame, grid: Mapping[str, Sequence[float]] = GRID) -> DataFrame:
    """NPV for each value of each variable; costs, tax and horizon stay at their defaults.

    Flows after launch are proportional to peak sales, those before do not depend on them, and the probability only scales
    the result.  So a drug is laid out by year once, and one aggregate sums both parts at its own rate and all flows at each
    rate of the grid; the grid's rows are made from these sums.
    """
    d = with_assumptions(drugs)
    y = by_year(d)
    flow = cash_flow(F.col("year"), F.col("revenue"), F.col("years_to_launch"))
    before = F.col("year") < F.col("years_to_launch")
    own = flow / F.pow(1 + F.col("discount_rate"), F.col("year"))
    rates = [float(x) for x in grid.get("discount_rate", ())]
    sums = [F.sum(F.when(before, own).otherwise(0.0)).alias("_pre"), F.sum(F.when(before, 0.0).otherwise(own)).alias("_post")]
    sums += [F.sum(flow / F.pow(F.lit(1 + x), F.col("year"))).alias(f"_r{k}") for k, x in enumerate(rates)]
    g = y.groupBy("drug_id", F.col("probability").alias("_p")).agg(*sums)
    base = F.col("_pre") + F.col("_post")
    npv = {"peak_sales": lambda k, x: F.col("_pre") + F.col("_post") * x, "discount_rate": lambda k, x: F.col(f"_r{k}")}
    rows = [F.struct(F.lit(v).alias("variable"), F.lit(float(x)).alias("setting"),
                     (F.least(F.col("_p") * float(x), F.lit(1.0)) if v == "probability_of_success" else F.col("_p")).alias("s_prob"),
                     npv.get(v, lambda k, x: base)(k, float(x)).alias("npv_unadjusted")) for v, xs in grid.items() for k, x in enumerate(xs)]
    return g.select("drug_id", F.inline(F.array(*rows))).withColumn("npv_risk_adjusted", F.col("npv_unadjusted") * F.col("s_prob"))


def scenarios(drugs: DataFrame) -> DataFrame:
    """Bear, base and bull parameter sets."""
    d = with_assumptions(drugs)
    peak, prob, rate, launch = F.col("peak_sales"), F.col("probability"), F.col("discount_rate"), F.col("years_to_launch")
    row = lambda name, pk, pr, rt, la: F.struct(F.lit(name).alias("scenario"), pk.cast("double").alias("s_peak"), pr.alias("s_prob"), rt.alias("s_rate"), la.cast("int").alias("s_launch"))
    rows = F.array(row("bear", peak * 0.6, prob * 0.7, rate + 0.03, launch + 1), row("base", peak, prob, rate, launch),
                   row("bull", peak * 1.4, F.least(prob * 1.3, F.lit(1.0)), F.greatest(rate - 0.03, F.lit(0.08)), F.greatest(launch - 1, F.lit(0))))
    d = d.withColumn("_s", F.explode(rows)).select("*", "_s.*").drop("_s")
    return with_npv(d, "s_peak", "s_launch", "s_rate", keep=["drug_id", "scenario", "s_prob"]).withColumn("npv_risk_adjusted", F.col("npv_unadjusted") * F.col("s_prob"))


def portfolio_valuation(valued: DataFrame, caps: DataFrame, correlation: float = 0.9) -> DataFrame:
    """Sum of parts, diversification uplift, top-asset share, premium to cap, control value."""
    v = F.col("npv_risk_adjusted")
    g = valued.groupBy("company_id").agg(F.sum(v).alias("total_value"), F.sum(v * v).alias("_sq"), F.max(v).alias("_top"), F.count(F.lit(1)).alias("drugs"))
    hhi = F.col("_sq") / (F.col("total_value") * F.col("total_value"))
    uplift = 1 + (1 - hhi) * (1 - correlation) * 0.1
    g = g.withColumn("adjusted_value", F.when((F.col("drugs") > 1) & (F.col("total_value") > 0), F.col("total_value") * uplift).otherwise(F.col("total_value")))
    g = g.withColumn("top_share", F.when(F.col("total_value") > 0, F.col("_top") / F.col("total_value")))
    j = g.join(caps.select("company_id", "market_cap"), "company_id", "left")
    return (j.withColumn("premium_to_cap", F.when(F.col("market_cap") > 0, F.col("adjusted_value") / F.col("market_cap") - 1).otherwise(F.lit(0.0)))
            .withColumn("control_value", F.col("adjusted_value") * (1 + CONTROL_PREMIUM)).drop("_sq", "_top"))


def value_breakdown(valued: DataFrame) -> DataFrame:
    """Value and count by phase and by indication in one pass."""
    return valued.groupingSets([["phase"], ["area"]], "phase", "area").agg(F.sum("npv_risk_adjusted").alias("value"), F.count(F.lit(1)).alias("drugs"))


def top_assets(valued: DataFrame, n: int = 3) -> DataFrame:
    return top_per_key(valued, ["company_id"], [F.col("npv_risk_adjusted").desc(), F.col("drug_id")], n)


def peak_sales_estimate(drugs: DataFrame, price: str | None = None, typical: bool = True) -> DataFrame:
    """Market x share, or treated patients x price; share falls with years to market."""
    share = lookup(F.col("position"), SHARE, 0.15) * F.when(F.col("years_to_launch") > 0, F.pow(F.lit(LATE_SHARE_FACTOR), F.col("years_to_launch"))).otherwise(F.lit(1.0))
    size = lookup(F.col("area"), {k: v[0 if typical else 1] for k, v in MARKET.items()}, None)
    patients = lookup(F.col("area"), {k: v[2] for k, v in MARKET.items()}, None)
    est = size * F.col("market_share")
    if price:
        est = F.when(F.coalesce(F.col(price), F.lit(0)) != 0, patients * F.col("market_share") * F.col(price)).otherwise(est)
    return drugs.withColumn("market_share", share).withColumn("estimated_peak", est)
