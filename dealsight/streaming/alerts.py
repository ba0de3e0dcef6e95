"""Alert rules and levels; every function works on batch and streaming frames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.bands import truthy

FEW_RULES = 10_000  # rows up to which rules for all companies are broadcast

# ---- fixed values -----------------------------------------------------------
TIER_1_SCORE, CHANGE_ALERT, NEW_BELOW = 80.0, 15.0, 60.0


def alert_rule_match(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rules against signals: type, threshold and optional company list.

    Rules explode to one row per signal type, and per company where they name
    companies, so both branches are equi joins.  Rules for all companies are broadcast
    if their checked number is small; beyond, the signals of a type are dealt over parts
    that each hold its rules, as there are only few types.
    """
    on = rules.filter("is_active").select("rule_id", F.explode("signal_types").alias("signal_type"), "threshold", "companies")
    general = on.filter("companies IS NULL").drop("companies")
    named = on.filter("companies IS NOT NULL").select("rule_id", "signal_type", "threshold", F.explode("companies").alias("company_id"))
    hit = F.col("value") >= F.col("threshold")
    if general.limit(FEW_RULES + 1).count() <= FEW_RULES:
        a = signals.join(F.broadcast(general), "signal_type")
    else:
        parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        dealt = signals.withColumn("_part", F.pmod(F.xxhash64(*signals.columns), F.lit(parts)))
        a = dealt.join(general.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["signal_type", "_part"])
    a = a.filter(hit).select("rule_id", *signals.columns)
    b = signals.join(named, ["signal_type", "company_id"]).filter(hit).select("rule_id", *signals.columns)
    return a.unionByName(b)


def subscribers(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Subscribers of each event type whose minimum score is met."""
    h = hooks.filter("is_active").select("hook_id", F.explode("event_types").alias("event_type"), "min_score")
    d = events.join(h, "event_type")
    return d.filter(F.col("min_score").isNull() | (F.col("score") >= F.col("min_score")))


def score_alerts(scores: DataFrame) -> DataFrame:
    """Up to three alerts per score event; a previous score or change of 0 counts as none."""
    s, ch, prev = F.col("score"), F.col("score_change"), F.col("previous_score")
    a = lambda cond, kind, sev: F.when(cond, F.struct(F.lit(kind).alias("alert"), F.lit(sev).alias("severity")))
    alerts = F.array(a(s >= TIER_1_SCORE, "tier_1_candidate", "high"), a(truthy(ch) & (F.abs(ch) >= CHANGE_ALERT), "score_change", "medium"),
                     a((F.col("tier") == "tier_1") & (~truthy(prev) | (prev < NEW_BELOW)), "new_candidate", "high"))
    return scores.withColumn("_a", F.explode(F.filter(alerts, lambda x: x.isNotNull()))).select("*", "_a.*").drop("_a")


def profile_trigger(scores: DataFrame) -> DataFrame:
    """I8: report request per tier-1 candidate."""
    return scores.filter(F.col("tier") == "tier_1").select("company_id", "ts", F.lit("candidate_profile").alias("report_type"))


def watchlist_alerts(scores: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Listed companies whose score moved by their threshold while alerts are on."""
    w = watchlist.filter("alerts_enabled").select("company_id", "current_score", "alert_threshold")
    d = scores.join(w, "company_id").withColumn("change", F.col("score") - F.col("current_score"))
    return d.filter(F.abs("change") >= F.col("alert_threshold"))
