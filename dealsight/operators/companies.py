"""Company, programme and watch-list rows: filters, derived columns, labels, rollups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import at_least, lookup, tidy, truthy
from dealsight.functions.clock import at, whole_days

# ---- fixed values -----------------------------------------------------------
PHASE_POINTS = {"discovery": 1.0, "preclinical": 2.0, "phase_1": 3.5, "phase_1_2": 4.5, "phase_2": 6.0,
                "phase_2_3": 7.5, "phase_3": 8.5, "nda_bla": 9.5, "approved": 10.0, "discontinued": 0.0}
CLINICAL_PHASES = ["phase_1", "phase_1_2", "phase_2", "phase_2_3", "phase_3"]
LATE_PHASES = ["phase_2", "phase_2_3", "phase_3", "nda_bla"]
RISK_LEVELS = [(80, "very_high"), (65, "high"), (45, "medium"), (25, "low")]
RECOMMENDATIONS = [(75, "STRONG_ACQUISITION_CANDIDATE"), (60, "LIKELY_ACQUISITION_CANDIDATE"),
                   (45, "MODERATE_ACQUISITION_POTENTIAL"), (30, "LOW_ACQUISITION_LIKELIHOOD")]
ALERT_URGENCY = {"info": 3, "warning": 6, "critical": 10}
STALE_DAYS = 7


def active_rows(df: DataFrame) -> DataFrame:
    """Hide soft-deleted rows."""
    return df.filter(F.col("deleted_at").isNull())


def with_total(df: DataFrame, out: str = "total") -> DataFrame:
    """Attach the row count as a column (count first, then a one-row broadcast)."""
    total = df.agg(F.count(F.lit(1)).alias(out)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def page(df: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """One page with total and has_more."""
    off = (page_no - 1) * size
    return (with_total(df).orderBy(*order).offset(off).limit(size)
            .withColumn("has_more", F.lit(off + size) < F.col("total")))


def derived_columns(companies: DataFrame, constrained_below: float = 4.0) -> DataFrame:
    """Runway, enterprise value, cash-constrained flag, programme value ratio."""
    run = F.when(truthy(F.col("quarterly_burn")), tidy(F.col("cash") / F.col("quarterly_burn")))
    return (companies.withColumn("runway_quarters", run)
            .withColumn("enterprise_value", F.col("market_cap") + F.col("debt") - F.col("cash"))
            .withColumn("is_cash_constrained", F.coalesce(F.col("runway_quarters") < constrained_below, F.lit(False)))
            .withColumn("value_ratio", F.when(F.col("market_cap") != 0, tidy(F.col("potential") / F.col("market_cap")))))


def contains_all(col: str, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col(col))) == 0


def company_search(companies: DataFrame, name_part: str | None = None, areas: Sequence[str] = (),
                   min_cap: float | None = None, max_cap: float | None = None, constrained: bool | None = None,
                   skip: int = 0, limit: int | None = 100) -> DataFrame:
    """B1: optional predicates, largest first."""
    d = active_rows(companies)
    if name_part:
        d = d.filter(F.ilike("name", F.lit(f"%{name_part}%")))
    if areas:
        d = d.filter(contains_all("areas", areas))
    if min_cap is not None:
        d = d.filter(F.col("market_cap") >= min_cap)
    if max_cap is not None:
        d = d.filter(F.col("market_cap") <= max_cap)
    if constrained is not None:
        d = derived_columns(d).filter(F.col("is_cash_constrained") == constrained)
    d = d.orderBy(F.col("market_cap").desc(), "company_id").offset(skip)
    return d if limit is None else d.limit(limit)


def company_list(companies: DataFrame, scores: DataFrame, area: str | None = None, min_cap: float | None = None,
                 min_score: float | None = None, constrained_only: bool = False, sort_by: str = "ma_score",
                 descending: bool = True, page_no: int = 1, size: int = 20) -> DataFrame:
    """B2: filtered, sorted page with total."""
    d = derived_columns(active_rows(companies)).join(scores.select("company_id", "ma_score"), "company_id", "left")
    if area:
        d = d.filter(F.array_contains("areas", area))
    if min_cap is not None:
        d = d.filter(F.col("market_cap") >= min_cap)
    if min_score is not None:
        d = d.filter(truthy(F.col("ma_score")) & (F.col("ma_score") >= min_score))
    if constrained_only:
        d = d.filter("is_cash_constrained")
    key = {"ma_score": F.coalesce("ma_score", F.lit(0.0)), "market_cap": F.col("market_cap"), "name": F.col("name")}[sort_by]
    return page(d, [key.desc() if descending else key.asc(), F.col("company_id")], page_no, size)


def cash_constrained(companies: DataFrame, below_quarters: float = 4.0) -> DataFrame:
    """Companies with a known short runway, shortest first."""
    d = derived_columns(active_rows(companies))
    return d.filter(F.col("runway_quarters") < below_quarters).orderBy("runway_quarters", "company_id")


def company_statistics(companies: DataFrame) -> DataFrame:
    """Universe counts and cap totals."""
    cap = F.col("market_cap").cast("decimal(24,2)")
    return derived_columns(active_rows(companies)).agg(
        F.count(F.lit(1)).alias("total_companies"), F.coalesce(F.avg("market_cap"), F.lit(0.0)).alias("avg_market_cap"),
        F.coalesce(F.sum(cap), F.lit(0)).cast("double").alias("total_market_cap"),
        F.count_if("is_cash_constrained").alias("cash_constrained_count"))


def asset_flags(assets: DataFrame, expiries: DataFrame, as_of) -> DataFrame:
    """Phase points, patent years left (0 once expired), designation flag.

    ``expiries`` holds one expiry_date per asset_id.
    """
    left_days = whole_days(at(as_of), F.col("expiry_date").cast("timestamp_ntz"))
    years = F.when(left_days < 0, F.lit(0.0)).otherwise(tidy(left_days / 365.25))
    return (assets.join(expiries, "asset_id", "left")
            .withColumn("phase_score", lookup(F.col("phase"), PHASE_POINTS, 0.0))
            .withColumn("patent_years", F.when(F.col("expiry_date").isNotNull(), years))
            .withColumn("has_designation", F.col("orphan") | F.col("fast_track") | F.col("breakthrough")))


def asset_rollup(assets: DataFrame) -> DataFrame:
    """Programme counts, diversity, mean phase points and 0-10 strength per company."""
    live = F.col("phase") != "discontinued"
    g = assets.withColumn("_pts", lookup(F.col("phase"), PHASE_POINTS, 0.0)).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(live).alias("active"),
        F.count_if(F.col("phase").isin(CLINICAL_PHASES)).alias("clinical"),
        F.count_if(F.col("phase").isin(LATE_PHASES)).alias("late_stage"),
        F.count_if(F.col("phase") == "approved").alias("approved"),
        F.count_distinct("area").alias("diversity"),
        F.sum(F.when(live, F.col("_pts"))).alias("_sum"), F.sum("peak_sales").alias("potential"))
    avg = F.when(F.col("active") > 0, tidy(F.col("_sum") / F.col("active"))).otherwise(F.lit(0.0))
    strength = (F.least(F.col("clinical") / 5, F.lit(1.0)) * 3 + F.least(F.col("late_stage") / 3, F.lit(1.0)) * 3
                + F.col("avg_phase_score") / 10 * 2.5 + F.least(F.col("diversity") / 3, F.lit(1.0)) * 1.5)
    return (g.withColumn("avg_phase_score", avg)
            .withColumn("strength", tidy(F.least(strength, F.lit(10.0)))).drop("_sum"))


def score_labels(scores: DataFrame, as_of, ts: str = "calculated_at") -> DataFrame:
    """B21 (score part): risk level, adjusted score, staleness, recommendation."""
    s = F.col("score")
    return (scores.withColumn("risk_level", at_least(s, RISK_LEVELS, "very_low"))
            .withColumn("adjusted_score", tidy(s * F.col("confidence")))
            .withColumn("is_stale", whole_days(F.col(ts), at(as_of)) > STALE_DAYS)
            .withColumn("recommendation", F.when(s.isNull(), "INSUFFICIENT_DATA").otherwise(
                at_least(s, RECOMMENDATIONS, "MINIMAL_ACQUISITION_RISK"))))


def completeness(sections: Sequence[str]) -> Column:
    """Share of non-empty sections."""
    filled = sum((F.coalesce(truthy_text(c), F.lit(False)).cast("int") for c in sections), F.lit(0))
    return tidy(filled / len(sections))


def truthy_text(c: str) -> Column:
    text = F.col(c).cast("string")
    return text.isNotNull() & (text != "") & (text != "0") & (text != "0.0") & (text != "false")


def alert_urgency(level: Column, expires_at: Column, as_of) -> tuple[Column, Column]:
    """(urgency 1-10, expired?)."""
    return lookup(level, ALERT_URGENCY, 5), F.coalesce(at(as_of) > expires_at, F.lit(False))


def priority_actions(runway: Column, near_catalysts: Column, score: Column) -> Column:
    """List of actions; zero or NULL runway counts as unknown."""
    acts = F.array(
        F.when(truthy(runway) & (runway < 4), "monitor_cash"),
        F.when(near_catalysts > 0, F.concat(F.lit("track_catalysts:"), near_catalysts.cast("string"))),
        F.when(score >= 70, "monitor_rumours"))
    return F.filter(acts, lambda a: a.isNotNull())


def top_scored(scores: DataFrame, limit: int, min_score: float) -> DataFrame:
    """G1."""
    return scores.filter(F.col("ma_score") >= min_score).orderBy(F.col("ma_score").desc(), "company_id").limit(limit)


def top_candidates(scored: DataFrame, n: int, area: str | None = None) -> DataFrame:
    """N best, optionally in one area."""
    d = scored.filter(F.array_contains("areas", area)) if area else scored
    return d.orderBy(F.col("ma_score").desc(), "company_id").limit(n)


def top_parts(parts: Column, k: int = 3) -> Column:
    """K best of a nested array<struct<weighted, name>>."""
    return F.slice(F.reverse(F.array_sort(parts)), 1, k)


def sorted_nulls_last(df: DataFrame, descending: bool = True) -> DataFrame:
    """G3."""
    k = F.col("score").desc_nulls_last() if descending else F.col("score").asc_nulls_last()
    return df.orderBy(k, "company_id")


def filed_page(reports: DataFrame, kind: str | None = None, start=None, end=None, limit: int | None = None,
               kind_col: str = "kind", date_col: str = "report_date", key: str = "report_id") -> DataFrame:
    """Optional predicates, newest first."""
    d = reports
    if kind is not None:
        d = d.filter(F.col(kind_col) == kind)
    if start is not None:
        d = d.filter(F.col(date_col) >= at(start))
    if end is not None:
        d = d.filter(F.col(date_col) <= at(end))
    d = d.orderBy(F.col(date_col).desc(), key)
    return d if limit is None else d.limit(limit)


def watchlist_filters(entries: DataFrame, areas: Sequence[str] = (), acquirer: str | None = None,
                      risk: str | None = None, ticker: str | None = None, priority: str | None = None) -> DataFrame:
    """Primary or listed area, nested acquirer name, risk level, ticker, priority."""
    d = entries
    if areas:
        want = F.array(*[F.lit(a) for a in areas])
        d = d.filter(F.col("lead_area").isin(list(areas)) | F.coalesce(F.arrays_overlap("areas", want), F.lit(False)))
    if acquirer:
        d = d.filter(F.exists("acquirers", lambda a: a["name"] == acquirer))
    if risk:
        d = d.filter(F.col("risk_level") == risk)
    if ticker:
        d = d.filter(F.col("ticker") == ticker.upper())
    if priority:
        d = d.filter(F.col("priority") == priority.lower())
    return d
