"""Score history: one row per (company, day), so a company's rows are bounded by days."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.bands import first_match, tidy
from dealsight.functions.scale import cut, latest_per_key, positions, top_per_key

DAY = lambda c="score_date": F.unix_date(F.col(c))


def _by_company(*extra) -> W:
    return W.partitionBy("company_id").orderBy(*(extra or ("score_date",)))


def trend_label(change: Column, flat: float = 2.0) -> Column:
    return F.when(change.isNull() | (F.abs(change) < flat), "stable").when(change > 0, "up").otherwise("down")


def score_trend(scores: DataFrame, offset: int = 1) -> DataFrame:
    """F1: change against the score ``offset`` stored rows earlier."""
    change = F.col("score") - F.lag("score", offset).over(_by_company())
    return scores.withColumn("change", F.coalesce(change, F.lit(0.0))).withColumn("trend", trend_label(change))


def change_over(scores: DataFrame, days: Sequence[int]) -> DataFrame:
    """F2: change against the newest score at least N days old, one column per N."""
    d = scores.withColumn("_day", DAY())
    for k in days:
        w = W.partitionBy("company_id").orderBy("_day").rangeBetween(W.unboundedPreceding, -k)
        d = d.withColumn(f"change_{k}d", F.col("score") - F.last("score").over(w))
    return d.drop("_day")


def score_history(scores: DataFrame, as_of: str, days: int, limit: int = 100) -> DataFrame:
    """newest rows of the last N days per company."""
    d = scores.filter(F.col("score_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return top_per_key(d, ["company_id"], [F.col("score_date").desc()], limit)


def percentile_ranks(scores: DataFrame) -> DataFrame:
    """positional percentile per score date; 50 for a lone row."""
    p = positions(scores, ["score_date"], [F.col("score"), F.col("company_id")], "_pos", "_n")
    pct = F.when(F.col("_n") > 1, (F.col("_pos") - 1) / (F.col("_n") - 1) * 100).otherwise(F.lit(50.0))
    return p.withColumn("percentile", tidy(pct)).drop("_pos", "_n")


def latest(scores: DataFrame) -> DataFrame:
    """newest row per company."""
    return latest_per_key(scores, ["company_id"], ["score_date"])


def latest_with_ties(scores: DataFrame) -> DataFrame:
    """Every row on the newest date of its company."""
    w = W.partitionBy("company_id").orderBy(F.col("score_date").desc())
    return scores.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def latest_in_range(scores: DataFrame, low: float, high: float = 100.0, limit: int = 100) -> DataFrame:
    """Newest rows with low <= score <= high, best first."""
    return (latest_with_ties(scores).filter(F.col("score").between(low, high))
            .orderBy(F.col("score").desc(), "company_id").limit(limit))


def score_movers(scores: DataFrame, companies: DataFrame, limit: int = 20) -> DataFrame:
    """Largest non-zero 24 h moves among newest rows."""
    d = latest(change_over(scores, [1]).select("company_id", "score_date", "score", "change_1d"))
    d = d.filter(F.col("change_1d") != 0).join(companies.select("company_id", "name", "ticker"), "company_id")
    return d.orderBy(F.abs("change_1d").desc(), "company_id").limit(limit)


def weekly_watchlist(scores: DataFrame, companies: DataFrame, start: str, end: str, floor: float = 50.0) -> dict[str, DataFrame]:
    """Candidates, newly qualified, improved and the average, from one joined frame."""
    hist = change_over(scores, [7])
    first = scores.filter(F.col("score") >= floor).groupBy("company_id").agg(F.min("score_date").alias("first_qualified"))
    now = cut(latest(hist.select("company_id", "score_date", "score", "change_7d")))  # read by all four sections
    j = now.join(first, "company_id", "left").join(companies.select("company_id", "name", "ticker"), "company_id")
    best = [F.col("score").desc(), F.col("company_id")]
    return {
        "candidates": j.filter(F.col("score") >= floor).orderBy(*best).limit(50),
        "new": j.filter((F.col("score") >= floor) & (F.col("first_qualified") >= F.lit(start).cast("date"))
                        & (F.col("first_qualified") < F.lit(end).cast("date"))),
        "improved": j.filter(F.col("change_7d") >= 10).orderBy(F.col("change_7d").desc(), "company_id").limit(10),
        "average": now.filter(F.col("score") >= floor).agg(F.avg("score").alias("average_score")),
    }


def previous_asof(scores: DataFrame, min_age_days: int = 1, alert_over: float = 10.0) -> DataFrame:
    """Newest earlier score at least a day old, change and significance flag."""
    d = change_over(scores, [min_age_days]).withColumnRenamed(f"change_{min_age_days}d", "change")
    return (d.withColumn("previous", F.col("score") - F.col("change"))
            .withColumn("significant", F.coalesce(F.abs("change") > alert_over, F.lit(False))))


def sustained_below(scores: DataFrame, threshold: float, min_days: int) -> DataFrame:
    """runs of consecutive calendar days below ``threshold`` lasting ``min_days``."""
    low = scores.filter(F.col("score") < threshold).withColumn("_day", DAY())
    isl = low.withColumn("_grp", F.col("_day") - F.row_number().over(_by_company()))
    g = isl.groupBy("company_id", "_grp").agg(F.min("score_date").alias("start"), F.max("score_date").alias("end"),
                                              F.count(F.lit(1)).alias("days"))
    return g.filter(F.col("days") >= min_days).drop("_grp")


def score_volatility(scores: DataFrame, period: str = "month", flag_over: float = 15.0) -> DataFrame:
    """sample deviation of period-to-period change of the mean score."""
    per = (scores.groupBy("company_id", F.date_trunc(period, F.col("score_date").cast("timestamp_ntz")).alias("p"))
           .agg(F.avg("score").alias("m")))
    ch = per.withColumn("_c", F.col("m") - F.lag("m").over(W.partitionBy("company_id").orderBy("p")))
    g = ch.groupBy("company_id").agg(F.stddev_samp("_c").alias("volatility"))
    return g.withColumn("flag", F.coalesce(F.col("volatility") > flag_over, F.lit(False)))


def rerank(entries: DataFrame, by: Sequence[str] = ("watchlist",), score: str = "score", key: str = "ticker") -> DataFrame:
    """rank and percentile (n - i) / n per watch list."""
    p = positions(entries, list(by), [F.col(score).desc(), F.col(key)], "rank", "_n")
    return p.withColumn("percentile", (F.col("_n") - F.col("rank") + 1) / F.col("_n") * 100).drop("_n")


def watchlist_merge(snapshot: DataFrame, changes: DataFrame, by: str = "watchlist", key: str = "ticker") -> DataFrame:
    """H7: newest change per key over a snapshot; add / update / remove, then rerank.

    Adding a ticker that is already listed is reported in ``status`` and leaves the row as it was.
    """
    last = latest_per_key(changes.select(by, key, "seq", "action", F.col("score").alias("new_score")), [by, key], ["seq"])
    j = snapshot.select(by, key, "score").join(last, [by, key], "full_outer")
    dup = (F.col("action") == "add") & F.col("score").isNotNull()
    status = first_match([(dup, "duplicate_add"), (F.col("action") == "add", "added"),
                          ((F.col("action") == "update") & F.col("score").isNotNull(), "updated"),
                          (F.col("action") == "remove", "removed"), (F.col("score").isNull(), "ignored")], "kept")
    j = j.withColumn("status", status).filter(~F.col("status").isin("removed", "ignored"))
    score = F.when(F.col("status").isin("added", "updated"), F.coalesce("new_score", "score")).otherwise(F.col("score"))
    return rerank(j.select(by, key, "status", score.alias("score")), [by], "score", key)


def membership_diff(before: DataFrame, after: DataFrame, key: str = "company_id") -> DataFrame:
    """H5 / C14: added, removed and retained keys between two snapshots."""
    b, a = before.select(key), after.select(key)
    rows = [(a.exceptAll(b), "added"), (b.exceptAll(a), "removed"), (a.intersect(b), "retained")]
    out = None
    for d, lab in rows:
        d = d.withColumn("change", F.lit(lab))
        out = d if out is None else out.unionByName(d)
    return out
