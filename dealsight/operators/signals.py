"""Signal rows: filters, strength rules, flags, counts and digests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import below, clamp, first_match, lookup, points, tidy
from dealsight.functions.clock import at, whole_days
from dealsight.functions.scale import top_per_key

# ---- fixed values -----------------------------------------------------------
SEVERITY_ORDER = {"low": 1, "medium": 2, "high": 3, "critical": 4}
TRIAL_PHASE_POINTS = {"phase_1": 1.0, "phase_1_2": 1.5, "phase_2": 2.0, "phase_2_3": 3.0, "phase_3": 3.5, "phase_4": 1.0}
OUTCOME_POINTS = {"positive": 2.5, "negative": -3.0, "mixed": 0.5}
C_SUITE = ["ceo", "cfo", "coo", "cso", "cmo"]
STRATEGIC_WORDS = ["corporate development", "m&a", "business development", "strategy", "corp dev", "bd"]
PHARMA_WORDS = ["pharma", "therapeutics", "biogen", "pfizer", "merck"]


def severity_at_least(minimum: str) -> Column:
    return lookup(F.col("severity"), SEVERITY_ORDER, 0) >= SEVERITY_ORDER.get(minimum, 1)


def signal_filter(signals: DataFrame, types: Sequence[str] = (), start=None, end=None,
                  min_severity: str | None = None, limit: int = 100) -> DataFrame:
    """Newest matching signals of every company, at most ``limit`` each."""
    d = signals
    if types:
        d = d.filter(F.col("signal_type").isin(list(types)))
    if start is not None:
        d = d.filter(F.col("event_date") >= at(start))
    if end is not None:
        d = d.filter(F.col("event_date") <= at(end))
    if min_severity:
        d = d.filter(severity_at_least(min_severity))
    return top_per_key(d, ["company_id"], [F.col("event_date").desc(), F.col("signal_id")], limit)


def recent_signals(signals: DataFrame, as_of, days: int, severity: str | None = None,
                   signal_type: str | None = None) -> DataFrame:
    """Rows inside the trailing window."""
    d = signals.filter(F.col("event_date") >= at(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    if severity:
        d = d.filter(F.col("severity") == severity)
    return d.filter(F.col("signal_type") == signal_type) if signal_type else d


def any_word(text: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def strategic_role(role: Column) -> Column:
    return any_word(F.lower(role), STRATEGIC_WORDS)


def _patent_years(as_of) -> Column:
    d = whole_days(at(as_of), F.col("expiry_date"))
    return F.when(d < 0, F.lit(0.0)).otherwise(tidy(d / 365.25))


def signal_flags(wide: DataFrame, as_of) -> DataFrame:
    """Per-type boolean and value columns over the wide signal table."""
    value = F.abs("shares") * F.col("price")
    run = F.when(F.col("quarterly_burn") > 0, tidy(F.col("cash") / F.col("quarterly_burn")))
    d = (wide.withColumn("years_until_expiry", _patent_years(as_of)).withColumn("runway_quarters", run)
         .withColumn("transaction_value", value))
    y = F.col("years_until_expiry")
    return (d.withColumn("is_positive_outcome", (F.col("outcome") == "positive")
                         & (F.col("endpoint_met") | (F.col("status") == "completed")))
            .withColumn("is_late_stage", F.col("phase").isin("phase_2_3", "phase_3"))
            .withColumn("is_near_expiry", (y > 0) & (y <= 3))
            .withColumn("patent_type_score", F.least(points(F.col("is_composition"), 5.0) + points(F.col("is_method"), 3.0)
                                                     + points(F.col("is_formulation"), 2.0), F.lit(10.0)))
            .withColumn("is_significant", (F.col("transaction_value") >= 100000) | (F.abs("shares") >= 10000))
            .withColumn("is_c_suite", F.col("insider_role").isin(C_SUITE))
            .withColumn("is_senior_hire", F.col("seniority").isin("c_suite", "vp"))
            .withColumn("is_strategic_role", strategic_role(F.col("role")))
            .withColumn("is_cash_critical", F.coalesce(F.col("runway_quarters") < 2, F.lit(False)))
            .withColumn("weighted_score", tidy(F.col("relevance") * F.col("confidence")))
            .withColumn("age_days", whole_days(F.col("event_date"), at(as_of))))


def signal_strength(wide: DataFrame, as_of) -> DataFrame:
    """0-10 strength chosen by signal type from the flags of B19."""
    d = signal_flags(wide, as_of)
    f = F.col
    base = F.lit(5.0)
    trial = base + lookup(f("phase"), TRIAL_PHASE_POINTS, 0.0) + lookup(f("outcome"), OUTCOME_POINTS, 0.0) + points(f("endpoint_met"), 1.5)
    y = f("years_until_expiry")
    patent = (base + first_match([(f("is_near_expiry"), 3.0), (y < 5, 2.0), (y < 7, 1.0)], 0.0)
              + points(f("litigation"), 2.5) + points(f("drugs_covered") > 1, 1.0))
    trade_age = f("age_days")
    insider = (base + points(f("is_c_suite"), 1.5)
               + first_match([((f("transaction_type") == "sale") & ~f("is_planned"), 2.5),
                              (f("transaction_type") == "sale", 0.5), (f("transaction_type") == "purchase", -1.5)], 0.0)
               + points(f("is_significant"), 1.5) + first_match([(trade_age <= 30, 1.0), (trade_age <= 90, 0.5)], 0.0))
    hiring = (base + points(f("is_strategic_role"), 4.0) + lookup(f("seniority"), {"c_suite": 2.0, "vp": 1.5}, 0.0)
              + points(f("is_new_position"), 1.0) + points(any_word(F.lower("previous_company"), PHARMA_WORDS), 0.5))
    run = f("runway_quarters")
    financial = (base + below(run, [(2, 4.0), (4, 2.5), (6, 1.0)], 0.0) + points(f("going_concern"), 3.0)
                 + points(f("covenant_breach"), 2.0) + points(f("guidance_lowered"), 1.0))
    raw = first_match([(f("signal_type") == "clinical_trial", trial), (f("signal_type") == "patent", patent),
                       (f("signal_type") == "insider_transaction", insider), (f("signal_type") == "hiring", hiring),
                       (f("signal_type") == "financial", financial)], None)
    return d.withColumn("strength", tidy(F.when(raw.isNotNull(), clamp(raw, 0.0, 10.0))))


def digest_signals(signals: DataFrame, companies: DataFrame, start, end, min_significance: float = 0.5,
                   limit: int = 100) -> DataFrame:
    """Significant signals of the period with company names."""
    d = signals.filter((F.col("event_date") >= at(start)) & (F.col("event_date") < at(end))
                       & (F.col("confidence") >= min_significance))
    return (d.join(companies.select("company_id", "name", "ticker"), "company_id")
            .orderBy(F.col("confidence").desc(), F.col("event_date").desc(), "signal_id").limit(limit))


def count_by_type(signals: DataFrame, start=None, by: Sequence[str] = ("signal_type",)) -> DataFrame:
    """D2."""
    d = signals if start is None else signals.filter(F.col("event_date") >= at(start))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def signals_by_ids(signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Signals named by an id table."""
    return signals.join(wanted.select("signal_id").distinct(), "signal_id", "left_semi")


def type_rollup(signals: DataFrame, as_of, days: int, rescore_types: int = 3) -> DataFrame:
    """Mean value and count per company and type; rescore flag by distinct types."""
    per = (recent_signals(signals, as_of, days).groupBy("company_id", "signal_type")
           .agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n")))
    types = per.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_types"))
    return per.join(types, "company_id").withColumn("rescore", F.col("n_types") >= rescore_types)


def digest_stats(signals: DataFrame) -> DataFrame:
    """Type x severity rollup with companies and signals per company."""
    g = signals.rollup("signal_type", "severity").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(F.col("severity").isin("high", "critical")).alias("high_priority"),
        F.count_distinct("company_id").alias("companies"))
    return g.withColumn("per_company", F.try_divide("signals", "companies"))
