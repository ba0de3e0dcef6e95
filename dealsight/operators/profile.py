"""Per-company bundle of profile, score and bounded child lists."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dealsight.functions.bands import lookup
from dealsight.functions.scale import top_per_key


def newest_children(df: DataFrame, order: str, tie: str | None, keep: list[str], k: int, out: str) -> DataFrame:
    """At most k newest rows per company as one array of structs."""
    o = [F.col(order).desc()] + ([F.col(tie)] if tie else [])
    top = top_per_key(df.select("company_id", *keep), ["company_id"], o, k, "_rk")
    return top.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("_rk", *keep))).alias(out))


PROGRAMME_ORDER = {"preclinical": 0, "phase_1": 1, "phase_2": 2, "phase_3": 3, "nda_bla": 4, "approved": 5}


def programme_list(assets: DataFrame) -> DataFrame:
    """All programmes of a company, most advanced first.  The list is the result, one row a company."""
    rank = -F.coalesce(lookup(F.col("phase"), PROGRAMME_ORDER), F.lit(-1))
    rows = assets.select("company_id", F.struct(rank.alias("_rk"), "asset_id", "asset_name", "phase", "area").alias("_p"))
    return rows.groupBy("company_id").agg(F.array_sort(F.collect_list("_p")).alias("programmes"))


def buyer_list(matches: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` buyers with the highest match score, best first; ``matches`` is one row a (company, buyer)."""
    best = top_per_key(matches.select("company_id", "acquirer_id", "match_score", "likelihood"), ["company_id"], [F.col("match_score").desc(), F.col("acquirer_id")], k, "_rk")
    return best.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("_rk", "acquirer_id", "match_score", "likelihood"))).alias("buyers"))


def component_history(history: DataFrame, as_of: str, components: Sequence[str], days: int = 90) -> DataFrame:
    """Overall score and component scores of the last ``days``, oldest first; one entry a day and company."""
    recent = history.filter(F.col("score_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return recent.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("score_date", "score", *components))).alias("component_history"))


def deep_dive(companies: DataFrame, scores: DataFrame, assets: DataFrame, signals: DataFrame, patents: DataFrame,
              financials: DataFrame, history: DataFrame, as_of: str, matches: DataFrame | None = None,
              components: Sequence[str] = ()) -> DataFrame:
    """Every company at once; 50 signals, 20 patents, 8 periods, every score of the last 90 days, all programmes.

    With ``matches`` also the ten best buyers; with ``components`` (columns of ``history``) their history beside the score's.
    """
    recent = history.filter(F.col("score_date") >= F.date_sub(F.lit(as_of).cast("date"), 90))
    kids = [
        newest_children(signals, "event_date", "signal_id", ["signal_id", "event_date", "signal_type"], 50, "signals"),
        newest_children(patents, "expiry_date", "patent_id", ["patent_id", "expiry_date"], 20, "patents"),
        newest_children(financials, "as_of_date", None, ["as_of_date", "cash", "revenue"], 8, "financials"),
        recent.groupBy("company_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score_date", "score")))).alias("history")),
        assets.groupBy("company_id").agg(F.count(F.lit(1)).alias("assets")),
        scores.select("company_id", "ma_score"), programme_list(assets),
    ]
    if matches is not None:
        kids.append(buyer_list(matches))
    if components:
        kids.append(component_history(history, as_of, components))
    out = companies.select("company_id", "name", "ticker")
    for k in kids:
        out = out.join(k, "company_id", "left")
    return out
