"""Valuation queries (E24-E30) and model validation queries."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import DEAL_AS_OF as DEAL
from dealsight.functions.bands import sql_lookup, sql_tidy
from dealsight.operators import targets as tg, validation as va, valuation as op
from dealsight.plans.catalog import n, query, r, s
from dealsight.plans.deals import PAIRS
from dealsight.plans.targeting import AREAS, NAMES
from dealsight.plans import targeting

CP = lambda i: f"CAST({sql_lookup('curve', {k: v[i] for k, v in op.CURVES.items()}, op.CURVES['standard'][i])} AS DOUBLE)"


def rev_sql(peak="peak_sales", launch="years_to_launch"):
    y = f"(yr - {launch})"
    return f"""CASE WHEN {y} < 0 THEN 0e0 WHEN {y} < {CP(0)} THEN {peak} * (tanh(3 * ({y} / {CP(0)} - 0.5e0)) + 1) / 2 WHEN {y} < {CP(1)} THEN {peak}
  WHEN {y} < patent_life THEN {peak} * greatest(1 - 0.15e0 * ({y} - {CP(1)}) / (patent_life - {CP(1)}), {CP(2)} + 0.1e0)
  WHEN {y} = patent_life THEN {peak} * {CP(2)} ELSE {peak} * {CP(2)} * pow(0.9e0, least({y} - patent_life, 3)) END"""


def fcf_sql(launch="years_to_launch"):
    # (1 - .25 - .2 - .3 - .05) = .2 of revenue is EBIT, taxed at 15 %
    return f"CASE WHEN yr < {launch} THEN -CAST({sql_lookup('phase', op.BURN, 30e6)} AS DOUBLE) * pow(1.05e0, yr) ELSE (rev * 0.2e0) * 0.85e0 END"


POS = f"least(1e0, CAST({sql_lookup('phase', op.SUCCESS, 0)} AS DOUBLE) * CAST({sql_lookup('area', op.AREA_FACTOR, 1)} AS DOUBLE))"
RATE = f"CAST({sql_lookup('phase', op.DISCOUNT, 0.1)} AS DOUBLE)"
BASE = f"x_d AS (SELECT *, {POS} AS pos, {RATE} AS rate FROM d_drugs), x_y AS (SELECT d.*, yr FROM x_d d, (SELECT unnest(range(20)) AS yr))"
VALUED = f"{BASE}, x_rev AS (SELECT *, {rev_sql()} AS rev FROM x_y), x_v AS (SELECT drug_id, company_id, phase, area, pos, rate, sum({fcf_sql()} / pow(1 + rate, yr)) AS npv FROM x_rev GROUP BY ALL)"


@query("E24", "revenue_projection", f"WITH {BASE}, x_rev AS (SELECT *, {rev_sql()} AS rev FROM x_y) SELECT drug_id, CAST(yr AS BIGINT) AS year, round(rev, 2) AS revenue FROM x_rev")
def _revenue(t):
    return op.revenue_projection(t.drugs).select("drug_id", n("year"), r("revenue", 2))


@query("E25", "dcf_npv", f"WITH {VALUED} SELECT drug_id, round(pos, 6) AS probability, rate AS discount_rate, round(npv, 2) AS npv_unadjusted, round(npv * pos, 2) AS npv_risk_adjusted FROM x_v")
def _dcf(t):
    return op.dcf_npv(t.drugs).select("drug_id", r("probability"), "discount_rate", r("npv_unadjusted", 2), r("npv_risk_adjusted", 2))


@query("E26", "revenue_metrics", f"""WITH {BASE}, x_rev AS (SELECT *, 0.9e0 * ({rev_sql()}) AS rev FROM x_y)
SELECT drug_id, round(sum(rev), 0) AS total_revenue, round(max(rev), 2) AS peak_revenue, CAST(min(yr) FILTER (WHERE rev = m) AS BIGINT) AS years_to_peak, round(sum(rev) / 20, 0) AS average_revenue
FROM (SELECT *, max(rev) OVER (PARTITION BY drug_id) AS m FROM x_rev) q GROUP BY drug_id""")
def _metrics(t):
    return op.revenue_metrics(t.drugs, launch_probability=0.9).select("drug_id", r("total_revenue", 0), r("peak_revenue", 2), n("years_to_peak"), r("average_revenue", 0))


GRID_SQL = "x_g(variable, setting) AS (VALUES " + ", ".join(f"('{v}', {float(x)}e0)" for v, xs in op.GRID.items() for x in xs) + ")"


@query("E27", "sensitivity_grid", f"""WITH {BASE}, {GRID_SQL}, x_p AS (SELECT y.*, variable, setting, peak_sales * CASE WHEN variable = 'peak_sales' THEN setting ELSE 1e0 END AS pk,
    CASE WHEN variable = 'discount_rate' THEN setting ELSE rate END AS rt, CASE WHEN variable = 'probability_of_success' THEN least(1e0, pos * setting) ELSE pos END AS pr FROM x_y y, x_g),
x_rev AS (SELECT *, {rev_sql('pk')} AS rev FROM x_p)
SELECT drug_id, variable, setting, round(sum({fcf_sql()} / pow(1 + rt, yr)), 2) AS npv_unadjusted, round(sum({fcf_sql()} / pow(1 + rt, yr)) * max(pr), 2) AS npv_risk_adjusted FROM x_rev GROUP BY 1, 2, 3""")
def _sensitivity(t):
    return op.sensitivity_grid(t.drugs).select("drug_id", "variable", "setting", r("npv_unadjusted", 2), r("npv_risk_adjusted", 2))


@query("E28", "scenarios", f"""WITH {BASE}, x_s AS (SELECT * EXCLUDE (years_to_launch), 'bear' AS scenario, peak_sales * 0.6e0 AS pk, pos * 0.7e0 AS pr, rate + 0.03e0 AS rt, years_to_launch + 1 AS la FROM x_y
  UNION ALL SELECT * EXCLUDE (years_to_launch), 'base', peak_sales, pos, rate, years_to_launch FROM x_y
  UNION ALL SELECT * EXCLUDE (years_to_launch), 'bull', peak_sales * 1.4e0, least(1e0, pos * 1.3e0), greatest(0.08e0, rate - 0.03e0), greatest(0, years_to_launch - 1) FROM x_y),
x_rev AS (SELECT *, {rev_sql('pk', 'la')} AS rev FROM x_s)
SELECT drug_id, scenario, round(sum({fcf_sql('la')} / pow(1 + rt, yr)), 2) AS npv_unadjusted, round(sum({fcf_sql('la')} / pow(1 + rt, yr)) * max(pr), 2) AS npv_risk_adjusted FROM x_rev GROUP BY 1, 2""")
def _scenarios(t):
    return op.scenarios(t.drugs).select("drug_id", "scenario", r("npv_unadjusted", 2), r("npv_risk_adjusted", 2))


@query("E29", "portfolio_valuation", f"""WITH {VALUED}, g AS (SELECT company_id, sum(npv * pos) AS tv, sum(npv * pos * npv * pos) AS sq, max(npv * pos) AS top, count(*) AS drugs FROM x_v GROUP BY 1),
h AS (SELECT *, CASE WHEN drugs > 1 AND tv > 0 THEN tv * (1 + (1 - sq / (tv * tv)) * 0.1e0 * 0.1e0) ELSE tv END AS av FROM g)
SELECT h.company_id, drugs, round(tv, 0) AS total_value, round(av, 0) AS adjusted_value, round(CASE WHEN tv > 0 THEN top / tv END, 6) AS top_share, round(av / market_cap - 1, 6) AS premium_to_cap, round(av * 1.4e0, 0) AS control_value
FROM h JOIN d_companies c ON c.company_id = h.company_id""")
def _portfolio(t):
    d = op.portfolio_valuation(op.dcf_npv(t.drugs), t.companies)
    return d.select("company_id", "drugs", r("total_value", 0), r("adjusted_value", 0), r("top_share"), r("premium_to_cap"), r("control_value", 0))


@query("E29", "portfolio_breakdown", f"WITH {VALUED} SELECT phase, area, round(sum(npv * pos), 0) AS value, count(*) AS drugs FROM x_v GROUP BY GROUPING SETS ((phase), (area))")
def _breakdown(t):
    return op.value_breakdown(op.dcf_npv(t.drugs)).select("phase", "area", r("value", 0), "drugs")


@query("E29", "portfolio_top_assets", f"WITH {VALUED} SELECT company_id, drug_id, row_number() OVER (PARTITION BY company_id ORDER BY npv * pos DESC, drug_id) AS rank, round(npv * pos, 2) AS npv FROM x_v QUALIFY rank <= 3")
def _top_assets(t):
    return op.top_assets(op.dcf_npv(t.drugs)).select("company_id", "drug_id", n("rank"), r(F.col("npv_risk_adjusted"), 2).alias("npv"))


MK = lambda i: f"CAST({sql_lookup('area', {k: v[i] for k, v in op.MARKET.items()}, 'NULL')} AS DOUBLE)".replace("'NULL'", "NULL")


@query("E30", "peak_sales_estimate", f"""SELECT drug_id, round(sh, 6) AS market_share, round(CASE WHEN drug_id % 4 = 0 THEN {MK(0)} * sh ELSE {MK(2)} * sh * (drug_id % 4) * 1000 END, 2) AS estimated_peak
FROM (SELECT *, CAST({sql_lookup('position', op.SHARE, 0.15)} AS DOUBLE) * CASE WHEN years_to_launch > 0 THEN pow(0.75e0, years_to_launch) ELSE 1 END AS sh FROM d_drugs) q""")
def _peak(t):
    d = op.peak_sales_estimate(t.drugs.withColumn("price", (F.col("drug_id") % 4) * 1000), "price")
    return d.select("drug_id", r("market_share"), r("estimated_peak", 2))


# ---- validation ---------------------------------------------------------------
SCORE = "f_length * 0.5e0 + f_density * 0.2e0 + f_letter * 0.3e0"


def outcomes(t):
    score = F.col("f_length") * 0.5 + F.col("f_density") * 0.2 + F.col("f_letter") * 0.3
    return t.outcomes.withColumn("score", F.round(score, 6)).withColumn("probability", F.col("score") / 100)


X_OUT = f"x_o AS (SELECT *, round({SCORE}, 6) AS score, round({SCORE}, 6) / 100 AS probability FROM d_outcomes)"
ANNOUNCED = "TIMESTAMP '2024-01-16 00:00:00' + INTERVAL '1' DAY * (deal_id % 15)"


def announcements(t):
    return t.deals.select("deal_id", F.col("target_id").alias("company_id"), F.expr(ANNOUNCED).cast("timestamp_ntz").alias("announced"))


@query("K1", "point_in_time_backtest", f"""WITH g AS (SELECT deal_id, target_id AS company_id, o AS step, CAST({ANNOUNCED} AS DATE) - CAST(o + 1 AS INTEGER) AS cut FROM d_deals, (SELECT unnest(range(1, 25)) AS o))
SELECT deal_id, CAST(step AS BIGINT) AS step, step IN (1, 3, 6, 12) AS profile_step, (SELECT count(*) FROM d_signals s WHERE s.company_id = g.company_id AND CAST(event_date AS DATE) <= cut) AS signals,
  (SELECT round(max_by(score, score_date), 6) FROM d_scores s WHERE s.company_id = g.company_id AND score_date <= cut) AS score,
  (SELECT CAST(max(score_date) AS VARCHAR) FROM d_scores s WHERE s.company_id = g.company_id AND score_date <= cut) AS scored_on FROM g""")
def _backtest(t):
    # the data spans a month, so a step is a day here
    d = va.point_in_time_backtest(announcements(t), t.signals, t.scores, step_days=1)
    return d.select("deal_id", n("step"), "profile_step", n("signals"), r("score"), s("scored_on"))


CONF = """count(*) FILTER (WHERE score >= th AND outcome = 1) AS tp, count(*) FILTER (WHERE score >= th AND outcome <> 1) AS fp, count(*) FILTER (WHERE score < th AND outcome = 1) AS fn, count(*) FILTER (WHERE score < th AND outcome <> 1) AS tn"""
RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


@query("K2", "classification_metrics", f"WITH {X_OUT}, c AS (SELECT th AS threshold, {CONF} FROM x_o, (SELECT unnest([20e0, 30e0, 40e0, 50e0, 60e0, 70e0]) AS th) GROUP BY 1) SELECT threshold, tp, fp, fn, tn, {RATES} FROM c")
def _classification(t):
    d = va.classification_metrics(outcomes(t), [20, 30, 40, 50, 60, 70])
    return d.select("threshold", n("tp"), n("fp"), n("fn"), n("tn"), r("precision"), r("recall"), r("specificity"), r("f1"))


RANK = f"""{X_OUT}, x_k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, doc_id) k, sum(outcome) OVER (PARTITION BY period) rel FROM x_o),
x_h AS (SELECT *, sum(outcome) OVER (PARTITION BY period ORDER BY k) hits FROM x_k),
x_i AS (SELECT i, 1 / log2(i + 1) AS g FROM (SELECT unnest(range(1, 11)) AS i)),
x_rm AS (SELECT period, round(count(*) FILTER (WHERE k <= 5 AND outcome = 1) / 5, 6) AS p_at_5, round(count(*) FILTER (WHERE k <= 10 AND outcome = 1) / 10, 6) AS p_at_10,
  coalesce(sum(hits / k) FILTER (WHERE outcome = 1) / max(rel), 0) AS ap,
  round(CASE WHEN max(rel) > 0 THEN coalesce(sum(1 / log2(k + 1)) FILTER (WHERE k <= 10 AND outcome = 1), 0) / (SELECT sum(g) FROM x_i WHERE i <= least(10, max(x_h.rel))) ELSE 0 END, 6) AS ndcg_at_10 FROM x_h GROUP BY period)"""


@query("K3", "ranking_metrics", f"WITH {RANK} SELECT period, p_at_5, p_at_10, round(ap, 6) AS average_precision, ndcg_at_10, round(avg(ap) OVER (), 6) AS map FROM x_rm")
def _ranking(t):
    from dealsight.functions.scale import cut

    m = cut(va.ranking_metrics(outcomes(t), [5, 10]))
    mp = va.mean_average_precision(m).withColumn("_one", F.lit(1))
    return m.withColumn("_one", F.lit(1)).join(F.broadcast(mp), "_one").select("period", r("p_at_5"), r("p_at_10"), r("average_precision"), r("ndcg_at_10"), r("map"))


@query("K4", "lead_time", f"""WITH a AS (SELECT company_id, CASE WHEN value >= 200 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS level, min(event_date) AS ts FROM d_signals WHERE value >= 60 GROUP BY 1, 2),
j AS (SELECT level, floor((epoch_us({ANNOUNCED}) - epoch_us(ts)) / 864e8) AS d FROM d_deals x JOIN a ON a.company_id = x.target_id WHERE ts <= {ANNOUNCED})
SELECT level, count(*) AS n, round(avg(d), 6) AS mean_days, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75 FROM j GROUP BY 1""")
def _lead(t):
    lvl = F.when(F.col("value") >= 200, "high").when(F.col("value") >= 100, "medium").otherwise("low")
    alerts = t.signals.filter("value >= 60").select("company_id", F.col("event_date").alias("ts"), lvl.alias("level"))
    return va.lead_time(announcements(t), alerts).select("level", n("n"), r("mean_days"), r("p25"), r("median"), r("p75"))


@query("K5", "calibration", f"""WITH {X_OUT}, g AS (SELECT CAST(least(9, floor(probability * 10)) AS BIGINT) AS bin, count(*) AS n, avg(probability) AS p, avg(outcome) AS a, sum((probability - outcome) ** 2) AS sq FROM x_o GROUP BY 1)
SELECT bin, n, round(p, 6) AS predicted, round(a, 6) AS actual, round(sum(abs(p - a) * n) OVER () / sum(n) OVER (), 6) AS ece, round(sum(sq) OVER () / sum(n) OVER (), 6) AS brier FROM g""")
def _calibration(t):
    return va.calibration(outcomes(t)).select(n("bin"), "n", r("predicted"), r("actual"), r("ece"), r("brier"))


@query("K6", "match_accuracy", f"""WITH {PAIRS}, j AS (SELECT rk, d.deal_value AS a, c.market_cap * 1.5e0 AS p FROM d_deals d JOIN d_companies c ON c.company_id = d.target_id LEFT JOIN x_match m ON m.company_id = d.target_id AND m.acquirer_id = d.acquirer_id)
SELECT count(*) AS deals, round(avg(coalesce(rk <= 1, false)::INT), 6) AS top_1, round(avg(coalesce(rk <= 3, false)::INT), 6) AS top_3, round(avg(coalesce(rk <= 5, false)::INT), 6) AS top_5,
  round(avg(abs(p - a) / a) * 100, 4) AS mape, round(corr(p, a), 6) AS correlation FROM j""")
def _accuracy(t):
    from dealsight.operators import matching as ma

    m = ma.match_acquirers(t.companies.select("company_id", "areas"), t.acquirers, t.deals)
    d = t.deals.select(F.col("target_id").alias("company_id"), "acquirer_id", F.col("deal_value").alias("actual_value")).join(
        t.companies.select("company_id", (F.col("market_cap") * 1.5).alias("predicted_value")), "company_id")
    return va.match_accuracy(d, m).select("deals", r("top_1"), r("top_3"), r("top_5"), r("mape", 4), r("correlation"))


FACTORS = ["f_length", "f_density", "f_letter"]
X_LONG = "x_l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS v, outcome FROM d_outcomes" for f in FACTORS) + ")"
AUC = lambda by, v, src: f"(SELECT {by}, (sum(rk) FILTER (WHERE outcome = 1) - count(*) FILTER (WHERE outcome = 1) * (count(*) FILTER (WHERE outcome = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE outcome = 1) * count(*) FILTER (WHERE outcome <> 1), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2 AS rk FROM {src}) z GROUP BY {by})"


@query("K7", "factor_power", f"WITH {X_LONG}, c AS (SELECT factor, corr(v, outcome) AS correlation, count(*) AS n FROM x_l GROUP BY 1) SELECT c.factor, n, round(correlation, 6) AS correlation, round(auc, 6) AS auc FROM c JOIN {AUC('factor', 'v', 'x_l')} a ON a.factor = c.factor")
def _power(t):
    return va.factor_power(t.outcomes, FACTORS).select("factor", "n", r("correlation"), r("auc"))


VECTORS = va.weight_grid(3, 4)
VEC_SQL = "x_w(vector, a, b, c) AS (VALUES " + ", ".join(f"({i}, {a}e0, {b}e0, {c}e0)" for i, (a, b, c) in enumerate(VECTORS)) + ")"


@query("K8", "weight_search", f"""WITH {VEC_SQL}, g AS (SELECT CASE WHEN segment = 'en' THEN 'holdout' ELSE 'train' END AS split, vector, outcome, f_length * a + f_density * b + f_letter * c AS score, 50 AS th FROM d_outcomes, x_w),
m AS (SELECT split, vector, {CONF} FROM g GROUP BY 1, 2), k AS (SELECT split, vector, {RATES} FROM m)
SELECT CAST(vector AS BIGINT) AS vector, split, f1, precision, recall FROM k""")
def _search(t):
    d = t.outcomes.withColumn("split", F.when(F.col("segment") == "en", "holdout").otherwise("train"))
    return va.weight_search(d, FACTORS).select(n("vector"), "split", r("f1"), r("precision"), r("recall"))


@query("K8", "best_weights", f"""WITH {VEC_SQL}, g AS (SELECT CASE WHEN segment = 'en' THEN 'holdout' ELSE 'train' END AS split, vector, outcome, f_length * a + f_density * b + f_letter * c AS score, 50 AS th FROM d_outcomes, x_w),
m AS (SELECT split, vector, {CONF} FROM g GROUP BY 1, 2), k AS (SELECT split, vector, {RATES} FROM m),
b AS (SELECT vector, f1 FROM k WHERE split = 'train' ORDER BY f1 DESC, vector LIMIT 1)
SELECT CAST(b.vector AS BIGINT) AS vector, b.f1 AS train_f1, (SELECT f1 FROM k WHERE split = 'holdout' AND k.vector = b.vector) AS holdout_f1 FROM b""")
def _best_weights(t):
    d = t.outcomes.withColumn("split", F.when(F.col("segment") == "en", "holdout").otherwise("train"))
    found = va.weight_search(d, FACTORS).withColumn("f1", F.round("f1", 6))  # ties go to the smaller vector
    return va.best_weights(found).select(n("vector"), r("train_f1"), r("holdout_f1"))


RANKED_SQL = f"""{VEC_SQL}, g AS (SELECT CASE WHEN segment = 'en' THEN 'holdout' ELSE 'train' END AS split, period, vector, outcome, floor((0e0 + f_length * a + f_density * b + f_letter * c) / 0.01e0) AS bin FROM d_outcomes, x_w),
h AS (SELECT split, period, vector, bin, count(*) AS n, count(*) FILTER (WHERE outcome = 1) AS p FROM g GROUP BY ALL),
q AS (SELECT *, sum(p) OVER w / sum(n) OVER w AS pr FROM h WINDOW w AS (PARTITION BY split, period, vector ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT split, vector, avg(a) AS map FROM (SELECT split, period, vector, coalesce(sum(p * pr) / nullif(sum(p), 0), 0) AS a FROM q GROUP BY ALL) z GROUP BY 1, 2),
rk AS (SELECT split, vector, outcome, rank() OVER (PARTITION BY split, vector ORDER BY bin) + (count(*) OVER (PARTITION BY split, vector, bin) - 1) / 2 AS rk FROM g),
au AS (SELECT split, vector, (sum(rk) FILTER (WHERE outcome = 1) - count(*) FILTER (WHERE outcome = 1) * (count(*) FILTER (WHERE outcome = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE outcome = 1) * count(*) FILTER (WHERE outcome <> 1), 0) AS auc FROM rk GROUP BY 1, 2)"""


@query("K8", "weight_ranking", f"WITH {RANKED_SQL} SELECT ap.split, CAST(ap.vector AS BIGINT) AS vector, round(map, 6) AS map, round(auc, 6) AS auc FROM ap JOIN au ON au.split = ap.split AND au.vector = ap.vector")
def _weight_ranking(t):
    d = t.outcomes.withColumn("split", F.when(F.col("segment") == "en", "holdout").otherwise("train"))
    return va.weight_ranking(d, FACTORS).select("split", n("vector"), r("map"), r("auc"))


@query("K8", "best_weights_by_map", f"""WITH {RANKED_SQL}, b AS (SELECT vector, round(map, 6) AS map FROM ap WHERE split = 'train' ORDER BY round(map, 6) DESC, vector LIMIT 1)
SELECT CAST(b.vector AS BIGINT) AS vector, b.map AS train_map, (SELECT round(map, 6) FROM ap WHERE split = 'holdout' AND ap.vector = b.vector) AS holdout_map, (SELECT round(auc, 6) FROM au WHERE split = 'holdout' AND au.vector = b.vector) AS holdout_auc FROM b""")
def _best_by_map(t):
    d = t.outcomes.withColumn("split", F.when(F.col("segment") == "en", "holdout").otherwise("train"))
    found = va.weight_ranking(d, FACTORS).withColumn("map", F.round("map", 6))  # ties go to the smaller vector
    return va.best_by_map(found).select(n("vector"), r("train_map"), r("holdout_map"), r("holdout_auc"))


SHIFT = "(VALUES ('cash_position', 0.8e0), ('cash_position', 1.2e0), ('market_cap', 0.8e0), ('market_cap', 1.2e0), ('stock_return_52w', 0.8e0), ('stock_return_52w', 1.2e0)) p(input, factor)"


def _composite_sql(source):
    return f"""(SELECT company_id, input, factor, {' + '.join(f'{k} * {w}e0' for k, w in tg.RANKING_WEIGHTS.items())} AS score FROM ({targeting.FACTORS.split('AS (', 1)[1].rsplit(')', 1)[0].replace('FROM x_gates WHERE g1 AND g2 AND g3 AND g4 AND g5', f'FROM {source}')}) f)"""


@query("K9", "robustness", f"""WITH x_p0 AS (SELECT u.* REPLACE (CASE WHEN input = 'cash_position' THEN cash_position * factor ELSE cash_position END AS cash_position, CASE WHEN input = 'market_cap' THEN market_cap * factor ELSE market_cap END AS market_cap,
   CASE WHEN input = 'stock_return_52w' THEN stock_return_52w * factor ELSE stock_return_52w END AS stock_return_52w), input, factor FROM d_universe u, (SELECT * FROM {SHIFT} UNION ALL SELECT DISTINCT input, 1e0 FROM {SHIFT}) p),
x_p AS (SELECT *, CASE WHEN quarterly_burn_rate <= 0 THEN 999e0 ELSE cash_position / (quarterly_burn_rate / 3) END AS run FROM x_p0), x_s AS (SELECT * FROM {_composite_sql('x_p')})
SELECT s.input, s.factor, round(avg(abs(round(s.score, 9) - round(b.score, 9))), 6) AS mean_change, round(max(abs(round(s.score, 9) - round(b.score, 9))), 6) AS max_change, count(*) FILTER (WHERE abs(round(s.score, 9) - round(b.score, 9)) > 10) AS over_10
FROM x_s s JOIN x_s b ON b.company_id = s.company_id AND b.input = s.input AND b.factor = 1 WHERE s.factor <> 1 GROUP BY 1, 2""")
def _robustness(t):
    def score(d):
        f = tg.readiness_factors(tg.with_runway(d))
        return f.withColumn("score", F.round(sum((F.col(k) * F.lit(w) for k, w in tg.RANKING_WEIGHTS.items()), F.lit(0.0)), 9))

    d = va.robustness(t.universe, score, ["cash_position", "market_cap", "stock_return_52w"])
    return d.select("input", "factor", r("mean_change"), r("max_change"), n("over_10"))


@query("K9", "segment_bias", f"WITH {X_OUT} SELECT segment, period, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS variance, count(*) AS n FROM x_o GROUP BY GROUPING SETS ((segment), (period))")
def _bias(t):
    return va.segment_bias(outcomes(t), ["segment", "period"]).select("segment", "period", r("mean"), r("variance"), "n")


GONE = lambda c: f"CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{c}'), 1, 6) AS BIGINT) / 16777216e0 < missing THEN 50e0 ELSE coalesce({c}, 50e0) END"


@query("K9", "missing_data", f"""WITH x AS (SELECT missing, ({' + '.join(GONE(c) for c in FACTORS)}) / 3 AS score FROM d_outcomes, (SELECT unnest([0e0, 0.1e0, 0.25e0, 0.5e0]) AS missing))
SELECT missing, round(avg(score), 6) AS mean_score, count(*) AS n FROM x GROUP BY 1""")
def _missing(t):
    def score(d):
        f = sum((F.coalesce(F.col(c), F.lit(50.0)) for c in FACTORS), F.lit(0.0)) / 3
        return d.withColumn("score", f)

    return va.missing_data(t.outcomes, score, FACTORS, [0.1, 0.25, 0.5], "doc_id").select("missing", r("mean_score"), "n")


@query("K10", "drift", f"""WITH {X_OUT}, m AS (SELECT o.period, avg(score) AS ms, count(*) FILTER (WHERE score >= 50 AND outcome = 1) / nullif(count(*) FILTER (WHERE score >= 50), 0) AS pr FROM x_o o GROUP BY 1),
j AS (SELECT m.*, auc, (SELECT ms FROM m WHERE period = 'src0') AS bm, (SELECT pr FROM m WHERE period = 'src0') AS bp, (SELECT auc FROM {AUC('period', 'score', 'x_o')} WHERE period = 'src0') AS ba FROM m JOIN {AUC('period', 'score', 'x_o')} a ON a.period = m.period)
SELECT period, round(ms, 6) AS mean_score, round(pr, 6) AS precision, round(auc, 6) AS auc, concat_ws('|', CASE WHEN (ba - auc) / ba * 100 > 10 THEN 'retrain' WHEN (ba - auc) / ba * 100 > 5 THEN 'warning' END,
  CASE WHEN (bp - pr) / nullif(bp, 0) * 100 > 10 THEN 'investigate' END, CASE WHEN abs(ms - bm) > 5 THEN 'recalibrate' END) AS labels FROM j""")
def _drift(t):
    d = va.drift(outcomes(t), "src0")
    return d.select("period", r("mean_score"), r("precision"), r("auc"), F.array_join("labels", "|").alias("labels"))
