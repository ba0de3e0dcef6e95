"""Backtesting and model validation as batch jobs."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dealsight.functions.clock import whole_days
from dealsight.functions.scale import exact_quantiles, join_on, positions, running_sum


# ---- fixed values -----------------------------------------------------------
PROFILE_STEPS = (12, 6, 3, 1)  # months before announcement at which a profile is rebuilt
TRAJECTORY_STEPS = 24


def point_in_time_backtest(deals: DataFrame, signals: DataFrame, scores: DataFrame, steps: int = TRAJECTORY_STEPS,
                           profile_steps: Sequence[int] = PROFILE_STEPS, step_days: int = 30) -> DataFrame:
    """K1: the composite score and the signals known about each deal's target 1..``steps`` months before announcement.

    ``scores`` is the composite's history (company_id, score_date, score).  Everything depends on a company and a day alone: a
    company's days are rows, at most one of each kind, in which the running count is what was known and the running maximum
    of (day, score) the last score.  What holds at its cut-offs is one row a company, which its deals meet before they are
    laid out by step, so no row a step is dealt.  Deals that share a ``deal_id`` are given each other's cut-offs.
    """
    wanted = sorted({*range(1, steps + 1), *profile_steps})
    day = lambda announced, step: F.date_sub(announced.cast("date"), step * step_days + 1)
    number = lambda d: F.coalesce(F.unix_date(d), F.lit(-2**31))  # a key of a map is not NULL
    dates = deals.groupBy("company_id").agg(F.collect_set(F.struct(F.col("announced").cast("date").alias("d"))).alias("_dates"))  # a NULL date counts
    days = F.flatten(F.transform("_dates", lambda x: F.array(*[day(x["d"], k) for k in wanted])))
    probe = dates.select("company_id", F.explode(F.array_distinct(days)).alias("day"), F.lit(1).alias("kind"), F.lit(0).alias("n"), F.lit(None).cast("date").alias("_on"), F.lit(None).cast("double").alias("_score"))
    seen = signals.groupBy("company_id", F.col("event_date").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.select("company_id", "day", F.lit(0).alias("kind"), "n", F.lit(None).cast("date").alias("_on"), F.lit(None).cast("double").alias("_score"))
    known = scores.groupBy("company_id", F.col("score_date").cast("date").alias("day")).agg(F.max(F.col("score").cast("double")).alias("_score"))
    known = known.select("company_id", "day", F.lit(0).alias("kind"), F.lit(0).alias("n"), F.col("day").alias("_on"), "_score")
    rows = probe.unionByName(seen).unionByName(known).withColumn("_last", F.when(F.col("_on").isNotNull(), F.struct("_on", "_score")))
    so_far = W.partitionBy("company_id").orderBy("day", "kind").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("company_id", "day", "kind", F.sum("n").over(so_far).alias("signals"), F.max("_last").over(so_far).alias("_best")).where("kind = 1")
    at_days = rows.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct(number(F.col("day")), F.struct("signals", "_best")))).alias("_at"))
    whose = deals.select("deal_id", F.col("company_id").alias("_company"), F.col("announced").alias("_announced"))
    # sizes are estimated before companies' days are one row, so without the hint all of them may be broadcast
    met = join_on(deals.join(whose, "deal_id").withColumnRenamed("company_id", "_own").withColumnRenamed("_company", "company_id").hint("merge"), at_days, ["company_id"])
    met = met.select("*", F.explode(F.array(*[F.lit(x) for x in wanted])).alias("step"))
    found = F.try_element_at("_at", number(day(F.col("_announced"), F.col("step"))))
    own = [F.col("_own").alias(c) if c == "company_id" else F.col(c) for c in deals.columns if c != "deal_id"]
    return met.select("deal_id", "step", *own, F.col("step").isin(list(profile_steps)).alias("profile_step"), found["signals"].alias("signals"),
                      found["_best"]["_score"].alias("score"), found["_best"]["_on"].alias("scored_on"))


def classification_metrics(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """K2: confusion counts and rates per threshold, from one histogram of how many thresholds a score reaches."""
    steps = sorted({float(x) for x in thresholds})
    level = F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: F.col("score") >= x))
    h = scored.withColumn("_l", level).groupBy(*by, "_l").agg(F.count_if(F.col("outcome") == 1).alias("_p"), F.count_if(~(F.col("outcome") == 1)).alias("_n"))
    return _rates(_curve(h, steps, by), by)


def _curve(h: DataFrame, steps: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Confusion counts at every threshold, from the rows per level (how many of ``steps`` a score reaches)."""
    total = lambda c, on: F.aggregate(F.filter("_h", on), F.lit(0).cast("long"), lambda a, x: a + x[c])
    g = h.groupBy(*by).agg(F.collect_list(F.struct("_l", "_p", "_n")).alias("_h"))  # one entry a level
    g = g.select(*by, "_h", F.posexplode(F.array(*[F.lit(x) for x in steps])).alias("_k", "threshold"))
    hit, miss = (lambda x: x["_l"] > F.col("_k")), (lambda x: x["_l"] <= F.col("_k"))
    return g.select(*by, "threshold", total("_p", hit).alias("tp"), total("_n", hit).alias("fp"), total("_p", miss).alias("fn"), total("_n", miss).alias("tn"))


def _rates(g: DataFrame, by: Sequence[str]) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    g = (g.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
         .withColumn("specificity", ratio(c("tn"), c("tn") + c("fp"))))
    return g.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def ranking_metrics(scored: DataFrame, ks: Sequence[int], by: str = "period", key: str = "doc_id") -> DataFrame:
    """K3: P@K, NDCG@K and average precision per period.

    Rank among all rows and rank among relevant rows give the running hit count
    without a per-period running sum.
    """
    order = [F.col("score").desc(), F.col(key)]
    allr = positions(scored, [by], order, "k")
    rel = positions(allr.filter("outcome = 1").select(by, key, "score", "k"), [by], order, "hits", total="relevant")
    ap = rel.groupBy(by).agg((F.sum(F.col("hits") / F.col("k")) / F.max("relevant")).alias("average_precision"), F.max("relevant").alias("relevant"))
    aggs = []
    for K in ks:
        inside = (F.col("k") <= K) & (F.col("outcome") == 1)
        aggs += [(F.count_if(inside) / K).alias(f"p_at_{K}"),
                 F.sum(F.when(inside, 1 / F.log2(F.col("k") + 1)).otherwise(0.0)).alias(f"_dcg_{K}")]
    m = allr.groupBy(by).agg(*aggs).join(ap, by, "left")
    for K in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.coalesce("relevant", F.lit(0)), F.lit(K)), F.lit(1)).cast("int")),
                            F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        m = m.withColumn(f"ndcg_at_{K}", F.when(F.coalesce("relevant", F.lit(0)) > 0, F.col(f"_dcg_{K}") / ideal).otherwise(F.lit(0.0))).drop(f"_dcg_{K}")
    return m.withColumn("average_precision", F.coalesce("average_precision", F.lit(0.0))).drop("relevant")


def mean_average_precision(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.avg("average_precision").alias("map"))


def lead_time(deals: DataFrame, alerts: DataFrame) -> DataFrame:
    """K4: days from first alert to announcement, by score level.

    ``alerts`` is (company_id, ts, level); ``deals`` is (deal_id, company_id, announced).
    """
    first = alerts.groupBy("company_id", "level").agg(F.min("ts").alias("first_alert"))
    j = deals.join(first, "company_id").filter(F.col("first_alert") <= F.col("announced"))
    j = j.withColumn("lead_days", whole_days(F.col("first_alert"), F.col("announced")))
    q = exact_quantiles(j, ["level"], "lead_days", "deal_id", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return j.groupBy("level").agg(F.avg("lead_days").alias("mean_days")).join(q, "level")


def calibration(scored: DataFrame, bins: int = 10, p: str = "probability") -> DataFrame:
    """K5: rows per probability bin with rate, gap and contribution to ECE and Brier score."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg("outcome").alias("actual"),
                                           F.sum((F.col(p) - F.col("outcome")) * (F.col(p) - F.col("outcome"))).alias("_sq"))
    tot = W.partitionBy(F.lit(1))  # at most ``bins`` rows here
    return (g.withColumn("ece", F.sum(F.abs(F.col("predicted") - F.col("actual")) * F.col("n")).over(tot) / F.sum("n").over(tot))
            .withColumn("brier", F.sum("_sq").over(tot) / F.sum("n").over(tot)).drop("_sq"))


def match_accuracy(deals: DataFrame, matches: DataFrame) -> DataFrame:
    """K6: how often the actual buyer is in the top 1 / 3 / 5, value error and correlation.

    ``deals``: company_id, acquirer_id, actual_value, predicted_value.
    """
    j = deals.join(matches.select("company_id", "acquirer_id", "rank"), ["company_id", "acquirer_id"], "left")
    rate = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"top_{k}")
    err = F.try_divide(F.abs(F.col("predicted_value") - F.col("actual_value")), F.col("actual_value"))
    return j.agg(F.count(F.lit(1)).alias("deals"), rate(1), rate(3), rate(5), (F.avg(err) * 100).alias("mape"),
                 F.corr("predicted_value", "actual_value").alias("correlation"))


def auc(scored: DataFrame, by: Sequence[str], score: str = "score", outcome: str = "outcome") -> DataFrame:
    """Area under the ROC curve from a (group, score) histogram with tied scores sharing their mean rank."""
    h = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(outcome) == 1).alias("_p"))
    h = running_sum(h, list(by), None, [score], F.col("_n"), "_cum")
    rank = F.col("_cum") - (F.col("_n") - 1) / 2
    g = h.groupBy(*by).agg(F.sum(rank * F.col("_p")).alias("_r"), F.sum("_p").alias("_pos"), F.sum("_n").alias("_all"))
    neg = F.col("_all") - F.col("_pos")
    return g.select(*by, F.try_divide(F.col("_r") - F.col("_pos") * (F.col("_pos") + 1) / 2, F.col("_pos") * neg).alias("auc"))


def factor_power(scored: DataFrame, factors: Sequence[str]) -> DataFrame:
    """K7: correlation with the outcome and AUC of each factor."""
    long = scored.select("outcome", *factors).unpivot(["outcome"], list(factors), "factor", "score")
    c = long.groupBy("factor").agg(F.corr("score", "outcome").alias("correlation"), F.count(F.lit(1)).alias("n"))
    return c.join(auc(long, ["factor"]), "factor")


def weight_grid(n: int, steps: int) -> list[tuple[float, ...]]:
    """All vectors of ``n`` weights in 1/steps units that total 1."""
    def rec(left: int, k: int):
        if k == 1:
            yield (left,)
        else:
            for i in range(left + 1):
                for rest in rec(left - i, k - 1):
                    yield (i, *rest)
    return [tuple(x / steps for x in v) for v in rec(steps, n)]


BIN = 0.01  # width of a score bin of the weight search


def weight_histogram(scored: DataFrame, factors: Sequence[str], steps: int = 4, by: Sequence[str] = ("split",)) -> DataFrame:
    """K8: rows and positives by (``by``, vector, score bin) for every weight vector.

    Scores are cut into bins of ``BIN``, so what leaves a task is bounded by vectors x bins, not by rows or thresholds; F1 at
    any threshold on a bin edge, average precision and AUC all come from it.
    """
    grid = weight_grid(len(factors), steps)
    bins = [F.struct(F.lit(i).alias("vector"), F.floor(sum((F.col(f) * F.lit(x) for f, x in zip(factors, v)), F.lit(0.0)) / BIN).alias("bin")) for i, v in enumerate(grid)]
    d = scored.select(*by, "outcome", F.inline(F.array(*bins)))
    return d.groupBy(*by, "vector", "bin").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("outcome") == 1).alias("positives"))


def _vectors(df: DataFrame, factors: Sequence[str], steps: int) -> DataFrame:
    """The rows with the weights of their vector."""
    grid = F.array(*[F.array(*[F.lit(x) for x in v]) for v in weight_grid(len(factors), steps)])
    return df.withColumn("weights", F.element_at(grid, F.col("vector") + 1))


def weight_search(scored: DataFrame, factors: Sequence[str], steps: int = 4, threshold: float = 50.0, split: str = "split") -> DataFrame:
    """K8: F1 of every weight vector on each split, best on the training split first."""
    edge = round(threshold / BIN)
    if abs(edge * BIN - threshold) > 1e-9:
        raise ValueError(f"the threshold must be a multiple of {BIN}")
    h = weight_histogram(scored, factors, steps, [split])
    h = h.groupBy(split, "vector", (F.col("bin") >= edge).cast("int").alias("_l")).agg(F.sum("positives").alias("_p"), F.sum(F.col("rows") - F.col("positives")).alias("_n"))
    m = _vectors(_rates(_curve(h, [threshold], [split, "vector"]), [split, "vector"]), factors, steps)
    return m.select(split, "vector", "weights", "f1", "precision", "recall")


def weight_ranking(scored: DataFrame, factors: Sequence[str], steps: int = 4, split: str = "split", period: str = "period") -> DataFrame:
    """K8: mean average precision over periods and AUC of every weight vector on each split.

    Rows of one bin are ties: they share the precision at the end of their bin and their mean rank.  A period without
    positives has an average precision of 0.
    """
    h = weight_histogram(scored, factors, steps, [split, period])
    down = W.partitionBy(split, period, "vector").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)  # a row a bin
    ap = h.withColumn("_p", F.sum("positives").over(down) / F.sum("rows").over(down)).groupBy(split, period, "vector").agg(
        F.coalesce(F.try_divide(F.sum(F.col("positives") * F.col("_p")), F.sum("positives")), F.lit(0.0)).alias("_ap"))
    whole = h.groupBy(split, "vector", "bin").agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))
    up = W.partitionBy(split, "vector").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rank = F.sum("rows").over(up) - (F.col("rows") - 1) / 2
    a = whole.withColumn("_r", rank).groupBy(split, "vector").agg(F.sum(F.col("_r") * F.col("positives")).alias("_s"), F.sum("positives").alias("_p"), F.sum("rows").alias("_n"))
    a = a.select(split, "vector", F.try_divide(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_n") - F.col("_p"))).alias("auc"))
    return _vectors(ap.groupBy(split, "vector").agg(F.avg("_ap").alias("map")).join(a, [split, "vector"]), factors, steps)


def best_by_map(ranking: DataFrame, split: str = "split", train: str = "train", test: str = "holdout") -> DataFrame:
    """K8: the weight vector with the best MAP on the training split, with its MAP and AUC on the holdout."""
    best = ranking.filter(F.col(split) == train).orderBy(F.col("map").desc(), "vector").limit(1).select("vector", "weights", F.col("map").alias("train_map"))
    return best.join(ranking.filter(F.col(split) == test).select("vector", F.col("map").alias("holdout_map"), F.col("auc").alias("holdout_auc")), "vector", "left")


def best_weights(search: DataFrame, split: str = "split", train: str = "train", test: str = "holdout") -> DataFrame:
    """K8: the weight vector with the best F1 on the training split, and its F1 on the holdout."""
    best = search.filter(F.col(split) == train).orderBy(F.col("f1").desc(), "vector").limit(1).select("vector", "weights", F.col("f1").alias("train_f1"))
    return best.join(search.filter(F.col(split) == test).select("vector", F.col("f1").alias("holdout_f1")), "vector", "left")


def robustness(frame: DataFrame, score, inputs: Sequence[str], shifts: Sequence[float] = (0.8, 1.2)) -> DataFrame:
    """K9: mean and largest score change when one input moves by a factor.

    ``score`` maps a frame to the same frame with a ``score`` column.  All variants of a row are columns beside it, so the
    rows are read once, not repeated, and meet nothing but one aggregate.
    """
    names = frame.columns
    points = [(i, s) for i in inputs for s in shifts]
    d = score(frame).withColumn("_base", F.col("score")).select(*names, "_base")
    for k, (i, s) in enumerate(points):
        kept = [*names, "_base", *[f"_c{j}" for j in range(k)]]
        d = score(d.withColumn("_own", F.col(i)).withColumn(i, F.col(i) * s)).withColumn(f"_c{k}", F.abs(F.col("score") - F.col("_base")))
        d = d.withColumn(i, F.col("_own")).select(*kept, f"_c{k}")
    aggs = [F.struct(F.lit(i).alias("input"), F.lit(float(s)).alias("factor"), F.avg(f"_c{k}").alias("mean_change"), F.max(f"_c{k}").alias("max_change"),
                     F.count_if(F.col(f"_c{k}") > 10).alias("over_10")) for k, (i, s) in enumerate(points)]
    return d.agg(F.array(*aggs).alias("_r")).select(F.inline("_r"))


def missing_data(frame: DataFrame, score, inputs: Sequence[str], shares: Sequence[float], key: str = "company_id") -> DataFrame:
    """K9: mean score with a hashed share of each input blanked, against the full data; one read of the rows."""
    names, levels = frame.columns, [0.0, *map(float, shares)]
    d = frame
    for i in inputs:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(i))), 1, 6), 16, 10).cast("double") / 2 ** 24
        d = d.withColumn(f"_u_{i}", u).withColumn(f"_own_{i}", F.col(i))
    helpers = [f"{p}_{i}" for i in inputs for p in ("_u", "_own")]
    for k, share in enumerate(levels):
        for i in inputs:
            d = d.withColumn(i, F.when(F.col(f"_u_{i}") < share, F.lit(None)).otherwise(F.col(f"_own_{i}")))
        d = score(d).withColumn(f"_s{k}", F.col("score")).select(*names, *helpers, *[f"_s{j}" for j in range(k + 1)])
    aggs = [F.struct(F.lit(x).alias("missing"), F.avg(f"_s{k}").alias("mean_score"), F.count(F.lit(1)).alias("n")) for k, x in enumerate(levels)]
    return d.agg(F.array(*aggs).alias("_r")).select(F.inline("_r"))


def segment_bias(scored: DataFrame, segments: Sequence[str]) -> DataFrame:
    """K9: mean and variance of the score per segment, one pass over grouping sets."""
    return scored.groupingSets([[s] for s in segments], *segments).agg(F.avg("score").alias("mean"), F.var_pop("score").alias("variance"), F.count(F.lit(1)).alias("n"))


def drift(scored: DataFrame, baseline: str, by: str = "period", threshold: float = 50.0) -> DataFrame:
    """AUC, precision and mean score of each period against the baseline period, with labels."""
    pos, hit = F.col("outcome") == 1, F.col("score") >= threshold
    m = scored.groupBy(by).agg(F.avg("score").alias("mean_score"), F.try_divide(F.count_if(hit & pos), F.count_if(hit)).alias("precision"))
    m = m.join(auc(scored, [by]), by)
    b = m.filter(F.col(by) == baseline).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"b_{c}") for c in ("mean_score", "precision", "auc")])
    j = m.withColumn("_one", F.lit(1)).join(F.broadcast(b), "_one").drop("_one")
    drop = (F.col("b_auc") - F.col("auc")) / F.col("b_auc") * 100
    pd = F.try_divide(F.col("b_precision") - F.col("precision"), F.col("b_precision")) * 100
    lab = F.filter(F.array(F.when(drop > 10, "retrain").when(drop > 5, "warning"), F.when(pd > 10, "investigate"),
                           F.when(F.abs(F.col("mean_score") - F.col("b_mean_score")) > 5, "recalibrate")), lambda x: x.isNotNull())
    return j.withColumn("auc_drop_pct", drop).withColumn("labels", lab)
