"""K1 with the composite rebuilt: every component from what was known at each cut-off before a deal.

Decayed sums at any cut-off come from running sums.  A signal's weight is a constant when it is fresh, 2^(-age / half-life)
after that and a floor when it is old.  The middle part is 2^(-T / half-life) times a sum of 2^(t / half-life), which does
not depend on the cut-off T, so three differences of running sums by day replace a join of cut-offs and signals.

Rows are summed by company and day before they meet a window, so a window holds a row a day and not a row a signal, and
companies and cut-offs are distinct: many deals of one target on one day are one cut-off.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.bands import clamp, tidy
from dealsight.functions.clock import DECAY_FLOOR, DEFAULT_HALF_LIFE, RECENT_BOOST, RECENT_DAYS
from dealsight.functions.scale import cut, top_per_key
from dealsight.operators import components as co
from dealsight.operators.matching import spread
from dealsight.operators.validation import PROFILE_STEPS, TRAJECTORY_STEPS

SPAN_DAYS = 32  # cut-offs of one span see a patent change its band once at most, as bands are years
ORIGIN = 10957  # 2000-01-01 in days: exponents stay small around it
DAY = 86_400_000_000


def half_days(ts: Column) -> Column:
    """Whole midnights have even numbers, the time between two of them the odd one."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return 2 * F.floor(us / F.lit(DAY)) + F.when(us % F.lit(DAY) == 0, 0).otherwise(1)


def cut_offs(deals: DataFrame, steps: int = TRAJECTORY_STEPS, profile_steps: Sequence[int] = PROFILE_STEPS, step_days: int = 30) -> DataFrame:
    """deal_id, company_id, step, profile_step and ``day``: the last day that is known."""
    wanted = sorted({*range(1, steps + 1), *profile_steps})
    grid = deals.select("deal_id", "company_id", "announced", F.explode(F.array(*[F.lit(x) for x in wanted])).alias("step"))
    day = F.date_sub(F.col("announced").cast("date"), F.col("step") * step_days + 1)
    return grid.select("deal_id", "company_id", "step", F.col("step").isin(list(profile_steps)).alias("profile_step"), day.alias("day"))


def running_at(daily: DataFrame, probes: DataFrame, sums: Sequence[str], tops: Sequence[str] = ()) -> DataFrame:
    """Running sums and maxima of (company_id, u) rows up to and with each probed ``u``."""
    rows = daily.select("company_id", "u", F.lit(0).alias("_kind"), *sums, *tops)
    none = [F.lit(0).cast(daily.schema[c].dataType).alias(c) for c in sums] + [F.lit(None).cast(daily.schema[c].dataType).alias(c) for c in tops]
    rows = rows.unionByName(probes.select("company_id", "u", F.lit(1).alias("_kind"), *none))
    so_far = W.partitionBy("company_id").orderBy("u", "_kind").rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("company_id", "u", "_kind", *[F.sum(c).over(so_far).alias(c) for c in sums], *[F.max(c).over(so_far).alias(c) for c in tops])
    return out.where("_kind = 1").drop("_kind")


def decayed_sums(feed: DataFrame, cuts: DataFrame, lookback_months: int, half_life: float = DEFAULT_HALF_LIFE) -> DataFrame:
    """company_id, day, points, signals, last_updated: what (company_id, ts, points) had added up to by the end of each day."""
    oldest = math.floor(half_life * math.log2(1 / DECAY_FLOOR))  # the last age above the floor
    u = half_days(F.col("ts"))
    days = F.floor((F.col("u") + 1) / 2)  # the midnight at or after the signal
    daily = feed.select("company_id", u.alias("u"), "ts", F.col("points").cast("double").alias("points"))
    daily = daily.withColumn("_e", F.col("points") * F.pow(F.lit(2.0), (days - ORIGIN) / F.lit(float(half_life))))
    daily = daily.groupBy("company_id", "u").agg(F.sum("points").alias("_p"), F.sum("_e").alias("_e"), F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    t = F.unix_date(F.date_add("day", 1))  # the midnight that ends the day
    start = 2 * F.unix_date(F.add_months(F.date_add("day", 1), -lookback_months)) - 1
    ends = [2 * t - 1, 2 * (t - RECENT_DAYS + 1) - 2, 2 * (t - oldest) - 2, start]
    grid = cuts.select("company_id", "day", t.alias("_t"), start.alias("_start"), F.posexplode(F.array(*[F.greatest(e, start) for e in ends])).alias("_k", "u"))
    vals = running_at(daily, grid.select("company_id", "u").distinct(), ["_p", "_e", "_n"], ["_last"])
    part = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    g = grid.join(vals, ["company_id", "u"]).groupBy("company_id", "day").agg(
        F.first("_t").alias("_t"), F.first("_start").alias("_start"), part("_last", 0).alias("_last"),
        *[part(c, k).alias(f"{c}{k}") for c in ("_p", "_e", "_n") for k in range(4)])
    c = F.col
    middle = (c("_e1") - c("_e2")) * F.pow(F.lit(2.0), -(c("_t") - ORIGIN) / F.lit(float(half_life)))
    points = RECENT_BOOST * (c("_p0") - c("_p1")) + middle + DECAY_FLOOR * (c("_p2") - c("_p3"))
    g = g.select("company_id", "day", points.alias("points"), (c("_n0") - c("_n3")).alias("signals"), "_last", "_start")
    seen = F.when(half_days(c("_last")) > c("_start"), c("_last"))
    return g.where("signals > 0").select("company_id", "day", "points", "signals", seen.alias("last_updated"))


def counts_at(feed: DataFrame, cuts: DataFrame, lookback_months: int, counts: dict[str, Column]) -> DataFrame:
    """company_id, day and, by name, how many rows (company_id, ts, ...) in the lookback meet each condition."""
    daily = feed.select("company_id", half_days(F.col("ts")).alias("u"), *[F.when(on, 1).otherwise(0).alias(k) for k, on in counts.items()])
    daily = daily.groupBy("company_id", "u").agg(*[F.sum(k).alias(k) for k in counts])
    t = F.unix_date(F.date_add("day", 1))
    start = 2 * F.unix_date(F.add_months(F.date_add("day", 1), -lookback_months)) - 1
    grid = cuts.select("company_id", "day", F.posexplode(F.array(2 * t - 1, start)).alias("_k", "u"))
    vals = running_at(daily, grid.select("company_id", "u").distinct(), list(counts))
    sign = F.when(F.col("_k") == 0, 1).otherwise(-1)
    return grid.join(vals, ["company_id", "u"]).groupBy("company_id", "day").agg(*[F.sum(F.coalesce(F.col(k), F.lit(0)) * sign).alias(k) for k in counts])


def as_of_rows(facts: DataFrame, ts: str, cuts: DataFrame, limit: Column) -> DataFrame:
    """The newest row of each company before ``limit``, for every cut-off that has one."""
    body = [c for c in facts.columns if c != "company_id"]
    daily = facts.groupBy("company_id", F.col(ts).cast("timestamp_ntz").alias("_at")).agg(F.max_by(F.struct(*body), F.struct(ts)).alias("_row"))
    rows = daily.select("company_id", "_at", F.lit(1).alias("_kind"), F.lit(None).cast("date").alias("day"), "_row")
    probes = cuts.select("company_id", limit.cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_kind"), "day", F.lit(None).cast(daily.schema["_row"].dataType).alias("_row"))
    so_far = W.partitionBy("company_id").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.unionByName(probes).withColumn("_row", F.last("_row", ignorenulls=True).over(so_far))
    return rows.where("_kind = 0 AND _row IS NOT NULL").select("company_id", "day", "_row.*")


def patent_rows(patents: DataFrame, cuts: DataFrame, end: Column) -> DataFrame:
    """E3 for every (company_id, day) of ``cuts``, from the patents that live at ``end``; its ``company_id`` is a struct of both.

    A patent that scores alike at the first and the last cut-off of a span of days scores so at all of them: such patents are
    counts of equal scores by span, and only the best of them meet its cut-offs.  The few others are laid out by cut-off.
    """
    most = max(map(len, co.PATENT_TOP_WEIGHTS.values()))
    c = cuts.select("company_id", "day", end.alias("_end"), F.floor(F.unix_date("day") / F.lit(SPAN_DAYS)).alias("_span"))
    spans = c.groupBy("company_id", "_span").agg(F.min("_end").alias("_first"), F.max("_end").alias("_last"))
    met = spans.join(patents, "company_id").where(F.col("expiry_date") >= F.col("_first"))
    met = met.withColumn("_a", co.years_left(F.col("_first"))).withColumn("_b", co.years_left(F.col("_last")))
    met = met.withColumn("patent_score", co.patent_score("_b"))
    same = (co.patent_score("_a") == F.col("patent_score")) & (F.col("expiry_date") >= F.col("_last"))
    own = F.struct("expiry_date", "is_composition", "is_method", "is_formulation", "claims_count", "citations_count")
    met = met.withColumn("_same", same).groupBy("company_id", "_span", F.when(F.col("_same"), F.col("patent_score")).alias("patent_score"),
                                                F.when(~F.col("_same"), own).alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    met = cut(met)
    top = lambda df, keys: df.select(*keys, F.explode(F.array_repeat("patent_score", F.least("_n", F.lit(most)).cast("int"))).alias("patent_score"))
    kept = met.where("_own IS NULL")
    best = top_per_key(top(kept, ["company_id", "_span"]), ["company_id", "_span"], [F.col("patent_score").desc()], most, "_rk").drop("_rk")
    key = F.struct("company_id", "day").alias("company_id")
    moved = c.join(met.where("_own IS NOT NULL").select("company_id", "_span", "_n", "_own.*"), ["company_id", "_span"]).where(F.col("expiry_date") >= F.col("_end"))
    moved = moved.withColumn("_years", co.years_left(F.col("_end"))).select(key, co.patent_score("_years").alias("patent_score"), "_n")
    many = c.join(kept.groupBy("company_id", "_span").agg(F.sum("_n").alias("_n")), ["company_id", "_span"]).select(key, "_n")
    many = many.unionByName(moved.select("company_id", "_n")).groupBy("company_id").agg(F.sum("_n").alias("n"))
    return co.portfolio_scores(c.join(best, ["company_id", "_span"]).select(key, "patent_score").unionByName(top(moved, ["company_id"])), counts=many)


def component_rows(cuts: DataFrame, companies: DataFrame, assets: DataFrame, patents: DataFrame, financials: DataFrame, transactions: DataFrame,
                   holdings: DataFrame, pathways: DataFrame, interactions: DataFrame, issues: DataFrame, acquirers: DataFrame,
                   shift_days: int = 0) -> DataFrame:
    """Long component rows for every (company_id, day) of ``cuts``, from rows before the end of the day; their ``company_id``
    is a struct of both.

    ``shift_days`` is added to a cut-off for the tables dated by deals (assets, patents, financials), where those run on a
    clock of their own.
    """
    cuts = cut(cuts.select("company_id", "day").distinct().join(companies.select("company_id"), "company_id"))
    end = lambda days: F.date_add("day", 1 + days).cast("timestamp_ntz")
    key = F.struct("company_id", "day")
    known = lambda df: df.select(key.alias("company_id"), *[c for c in df.columns if c not in ("company_id", "day")])
    late = end(shift_days)
    met = lambda df: spread(cuts, "company_id").withColumn("_end", late).join(df, "company_id")  # few cut-offs that become many rows
    old = F.col("last_update").isNull() | (F.col("last_update").cast("timestamp_ntz") < F.col("_end"))
    insider = decayed_sums(co.insider_feed(transactions, holdings), cuts, 12)
    insider = known(insider).select("company_id", tidy(clamp(F.col("points") + 50, 0.0, 100.0)).alias("score"), "signals", "last_updated")
    talks = known(decayed_sums(co.talk_feed(interactions), cuts, 24)).withColumnRenamed("points", "_talk")
    found = known(counts_at(issues.withColumnRenamed("issue_date", "ts"), cuts, 24, {
        "clinical_holds": F.col("issue_type") == "clinical_hold", "warning_letters": F.col("issue_type") == "warning_letter"}))
    ways = known(cuts.join(pathways, "company_id"))
    fit = known(cuts.join(co.strategic_fit_component(companies, acquirers), "company_id"))
    money = known(co.financial_scores(as_of_rows(financials, "as_of_date", cuts, late).withColumn("_end", late), F.col("_end"))).select("company_id", "score")
    parts = {
        "pipeline": (co.asset_component(met(assets).where(old).withColumn("company_id", key), F.col("_end")), 0.0),
        "patent": (patent_rows(patents, cuts, late), 0.0),
        "financial": (money, 0.0), "insider": (insider, 50.0), "strategic_fit": (fit, 50.0),
        "regulatory": (co.regulatory_scores(ways, talks, found), 50.0),
    }
    return co.complete_components(cuts.select(key.alias("company_id")), parts)


def rebuilt_scores(cuts: DataFrame, weights: DataFrame, **feeds) -> DataFrame:
    """E9 and E10 for every (company_id, day) of ``cuts``; recency counts from the end of the day."""
    end = F.date_add(F.col("company_id.day"), 1).cast("timestamp_ntz")
    out = co.composite_score(component_rows(cuts, **feeds), weights, end)
    return out.select("company_id.company_id", "company_id.day", "overall_score", "confidence")


def component_scores(cuts: DataFrame, **feeds) -> DataFrame:
    """company_id, day and a column for each component's score."""
    wide = component_rows(cuts, **feeds).groupBy("company_id").pivot("component", list(co.DEFAULT_WEIGHTS)).agg(F.max("score"))
    return wide.select("company_id.company_id", "company_id.day", *co.DEFAULT_WEIGHTS)


def rebuilt_backtest(deals: DataFrame, steps: int = TRAJECTORY_STEPS, profile_steps: Sequence[int] = PROFILE_STEPS, step_days: int = 30, **feeds) -> DataFrame:
    """K1: deal_id, step, profile_step, day, overall_score and confidence of each deal's target at each step before it.

    ``feeds``: the weights and the tables of ``component_rows``.
    """
    grid = cut_offs(deals, steps, profile_steps, step_days)
    # sizes are estimated before rows are laid out by step, so without the hint all of them may be broadcast
    return grid.hint("merge").join(rebuilt_scores(grid, **feeds), ["company_id", "day"])
