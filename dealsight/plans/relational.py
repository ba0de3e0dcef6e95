"""Company, signal and score-history queries (B, C1-C3, C12-C18, D1-D2, F, G, H5, H7)."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import DEAL_AS_OF as DEAL, EVENT_AS_OF as NOW
from dealsight.functions.bands import sql_at_least, sql_below, sql_lookup, sql_tidy
from dealsight.operators import companies as co, history as hi, signals as si
from dealsight.plans.catalog import join_list, n, query, r, s
from dealsight.plans.scoring import DAYS, TS_DEAL, TS_NOW

ALIVE = "deleted_at IS NULL"
RUN = sql_tidy("cash / quarterly_burn")
X_DER = f"""x_der AS (SELECT *, CASE WHEN quarterly_burn <> 0 THEN {RUN} END AS runway_quarters FROM d_companies WHERE {ALIVE})"""


def universe(t):
    return t.companies.join(t.latest.select("company_id", "ma_score"), "company_id", "left")


@query("B1", "company_search", f"""SELECT company_id, name, market_cap FROM d_companies
WHERE {ALIVE} AND name ILIKE '%supplier#%' AND list_has_all(areas, ['oncology', 'neurology'])
  AND market_cap BETWEEN 5e8 AND 5e10 ORDER BY market_cap DESC""")
def _search(t):
    return co.company_search(t.companies, "supplier#", ["oncology", "neurology"], 5e8, 5e10, limit=None).select(
        "company_id", "name", "market_cap")


@query("B2", "company_list", f"""WITH {X_DER}, x AS (SELECT d.company_id, d.name, coalesce(ma_score, 0) AS k, ma_score, count(*) OVER () AS total
  FROM x_der d LEFT JOIN d_latest l ON l.company_id = d.company_id
  WHERE list_contains(areas, 'oncology') AND market_cap >= 1e8 AND ma_score >= 20)
SELECT company_id, name, round(ma_score, 6) AS ma_score, total, 25 < total AS has_more FROM x ORDER BY k DESC, company_id LIMIT 25""")
def _list(t):
    d = co.company_list(t.companies, t.latest, "oncology", 1e8, 20, page_no=1, size=25)
    return d.select("company_id", "name", r("ma_score"), n("total"), "has_more")


@query("B3", "active_rows", f"SELECT company_id, ticker FROM d_companies WHERE {ALIVE}")
def _active(t):
    return co.active_rows(t.companies).select("company_id", "ticker")


@query("B4", "cash_constrained", f"WITH {X_DER} SELECT company_id, runway_quarters FROM x_der WHERE runway_quarters < 4")
def _constrained(t):
    return co.cash_constrained(t.companies).select("company_id", "runway_quarters")


SIG = "FROM d_signals WHERE signal_type IN ('patent', 'insider_transaction') AND event_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND severity IN ('high', 'critical')"


@query("B5", "signal_filter", f"""SELECT company_id, signal_id, CAST(rk AS BIGINT) AS rank FROM (SELECT company_id, signal_id,
  row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, signal_id) rk {SIG}) x WHERE rk <= 5""")
def _signal_filter(t):
    d = si.signal_filter(t.signals, ["patent", "insider_transaction"], "2024-01-05", "2024-01-25", "high", 5)
    return d.select("company_id", "signal_id", n("rank"))


@query("B6", "recent_signals", f"SELECT signal_id, company_id, signal_type FROM d_signals WHERE event_date >= {TS_NOW} - INTERVAL 7 DAY AND severity = 'critical'")
def _recent(t):
    return si.recent_signals(t.signals, NOW, 7, "critical").select("signal_id", "company_id", "signal_type")


@query("B7", "company_derived_columns", f"""WITH {X_DER} SELECT company_id, runway_quarters, market_cap + debt - cash AS enterprise_value,
  coalesce(runway_quarters < 4, false) AS is_cash_constrained, {sql_tidy('potential / market_cap')} AS value_ratio FROM x_der""")
def _derived(t):
    return co.derived_columns(co.active_rows(t.companies)).select(
        "company_id", "runway_quarters", "enterprise_value", "is_cash_constrained", "value_ratio")


FLAGS = f"""x_flags AS (SELECT *, CASE WHEN dd < 0 THEN 0e0 ELSE {sql_tidy('dd / 365.25e0')} END AS yrs,
    abs(shares) * price AS tv, CASE WHEN quarterly_burn > 0 THEN {RUN} END AS rq,
    CAST({DAYS('event_date', TS_NOW)} AS BIGINT) AS age
  FROM (SELECT *, {DAYS(TS_NOW, 'expiry_date')} AS dd FROM d_wide) q)"""
STRATEGIC = "(" + " OR ".join(f"contains(lower(role), '{w}')" for w in si.STRATEGIC_WORDS) + ")"
PHARMA = "(" + " OR ".join(f"contains(lower(previous_company), '{w}')" for w in si.PHARMA_WORDS) + ")"


@query("B19", "signal_flags", f"""WITH {FLAGS} SELECT signal_id, age AS age_days, yrs AS years_until_expiry, round(tv, 4) AS transaction_value,
  outcome = 'positive' AND (endpoint_met OR status = 'completed') AS is_positive_outcome, phase IN ('phase_2_3', 'phase_3') AS is_late_stage,
  yrs > 0 AND yrs <= 3 AS is_near_expiry,
  CAST((CASE WHEN is_composition THEN 5 ELSE 0 END + CASE WHEN is_method THEN 3 ELSE 0 END + CASE WHEN is_formulation THEN 2 ELSE 0 END) AS DOUBLE) AS patent_type_score,
  tv >= 100000 OR abs(shares) >= 10000 AS is_significant, insider_role IN ('ceo', 'cfo', 'coo', 'cso', 'cmo') AS is_c_suite,
  seniority IN ('c_suite', 'vp') AS is_senior_hire, {STRATEGIC} AS is_strategic_role, rq AS runway_quarters,
  coalesce(rq < 2, false) AS is_cash_critical, {sql_tidy('relevance * confidence')} AS weighted_score FROM x_flags""")
def _flags(t):
    return si.signal_flags(t.wide, NOW).select(
        "signal_id", "age_days", "years_until_expiry", r("transaction_value", 4), "is_positive_outcome", "is_late_stage",
        "is_near_expiry", "patent_type_score", "is_significant", "is_c_suite", "is_senior_hire", "is_strategic_role",
        "runway_quarters", "is_cash_critical", "weighted_score")


@query("B8", "signal_strength_by_type", f"""WITH {FLAGS} SELECT signal_id, signal_type, {sql_tidy(f'''least(10e0, greatest(0e0, 5 + CASE signal_type
  WHEN 'clinical_trial' THEN {sql_lookup('phase', si.TRIAL_PHASE_POINTS, 0)} + {sql_lookup('outcome', si.OUTCOME_POINTS, 0)} + CASE WHEN endpoint_met THEN 1.5 ELSE 0 END
  WHEN 'patent' THEN CASE WHEN yrs > 0 AND yrs <= 3 THEN 3 WHEN yrs < 5 THEN 2 WHEN yrs < 7 THEN 1 ELSE 0 END + CASE WHEN litigation THEN 2.5 ELSE 0 END + CASE WHEN drugs_covered > 1 THEN 1 ELSE 0 END
  WHEN 'insider_transaction' THEN CASE WHEN insider_role IN ('ceo', 'cfo', 'coo', 'cso', 'cmo') THEN 1.5 ELSE 0 END
    + CASE transaction_type WHEN 'sale' THEN CASE WHEN is_planned THEN 0.5 ELSE 2.5 END WHEN 'purchase' THEN -1.5 ELSE 0 END
    + CASE WHEN tv >= 100000 OR abs(shares) >= 10000 THEN 1.5 ELSE 0 END + CASE WHEN age <= 30 THEN 1 WHEN age <= 90 THEN 0.5 ELSE 0 END
  WHEN 'hiring' THEN CASE WHEN {STRATEGIC} THEN 4 ELSE 0 END + CASE seniority WHEN 'c_suite' THEN 2 WHEN 'vp' THEN 1.5 ELSE 0 END
    + CASE WHEN is_new_position THEN 1 ELSE 0 END + CASE WHEN {PHARMA} THEN 0.5 ELSE 0 END
  ELSE {sql_below('rq', [(2, 4.0), (4, 2.5), (6, 1.0)], 0)} + CASE WHEN going_concern THEN 3 ELSE 0 END
    + CASE WHEN covenant_breach THEN 2 ELSE 0 END + CASE WHEN guidance_lowered THEN 1 ELSE 0 END END))''')} AS strength FROM x_flags""")
def _strength(t):
    return si.signal_strength(t.wide, NOW).select("signal_id", "signal_type", "strength")


EXPIRY = "x_exp AS (SELECT asset_id, max(expiry_date) AS expiry_date FROM d_patents GROUP BY asset_id)"


@query("B20", "asset_flags", f"""WITH {EXPIRY} SELECT a.asset_id, CAST({sql_lookup('phase', co.PHASE_POINTS, 0.0)} AS DOUBLE) AS phase_score,
  CASE WHEN expiry_date IS NULL THEN NULL WHEN expiry_date < {TS_DEAL} THEN 0e0 ELSE {sql_tidy(DAYS(TS_DEAL, 'expiry_date') + ' / 365.25e0')} END AS patent_years,
  orphan OR fast_track OR breakthrough AS has_designation FROM d_assets a LEFT JOIN x_exp e ON e.asset_id = a.asset_id""")
def _asset_flags(t):
    exp = t.patents.groupBy("asset_id").agg(F.max("expiry_date").alias("expiry_date"))
    return co.asset_flags(t.assets, exp, DEAL).select("asset_id", "phase_score", "patent_years", "has_designation")


LABELS = f"""x_lab AS (SELECT c.company_id, ma_score AS s, least(1e0, n_sig / 60e0) AS cf, CAST(lu AS TIMESTAMP) AS lu, runway_quarters AS rq, country, lead_asset, areas, n_cat
  FROM x_der c LEFT JOIN d_latest l ON l.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) AS n_sig, max(event_date) AS lu, count(*) FILTER (WHERE severity = 'critical') AS n_cat FROM d_signals GROUP BY 1) g ON g.company_id = c.company_id)"""


@query("B21", "score_labels", f"""WITH {X_DER}, {LABELS} SELECT company_id, {sql_at_least('s', [(b, f"'{v}'") for b, v in co.RISK_LEVELS], "'very_low'")} AS risk_level,
  {sql_tidy('s * cf')} AS adjusted_score, {DAYS('lu', TS_NOW)} > 7 AS is_stale,
  CASE WHEN s IS NULL THEN 'INSUFFICIENT_DATA' ELSE {sql_at_least('s', [(b, f"'{v}'") for b, v in co.RECOMMENDATIONS], "'MINIMAL_ACQUISITION_RISK'")} END AS recommendation,
  {sql_tidy("((country IS NOT NULL)::INT + (lead_asset IS NOT NULL)::INT + (rq IS NOT NULL AND rq <> 0)::INT + (s IS NOT NULL AND s <> 0)::INT) / 4e0")} AS completeness,
  concat_ws('|', CASE WHEN rq <> 0 AND rq < 4 THEN 'monitor_cash' END, CASE WHEN n_cat > 0 THEN 'track_catalysts:' || n_cat END, CASE WHEN s >= 70 THEN 'monitor_rumours' END) AS actions,
  CASE WHEN s >= 70 THEN 10 WHEN s >= 40 THEN 6 ELSE 3 END AS urgency, coalesce({TS_NOW} > lu + INTERVAL 1 DAY, false) AS expired
FROM x_lab""")
def _labels(t):
    g = t.signals.groupBy("company_id").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 60).alias("confidence"),
                                            F.max("event_date").alias("calculated_at"),
                                            F.count_if(F.col("severity") == "critical").alias("n_cat"))
    d = co.derived_columns(co.active_rows(universe(t))).join(g, "company_id", "left").withColumnRenamed("ma_score", "score")
    d = co.score_labels(d, NOW)
    level = F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 40, "warning").otherwise("info")
    urg, expired = co.alert_urgency(level, F.col("calculated_at") + F.expr("INTERVAL 1 DAY"), NOW)
    return d.select("company_id", "risk_level", "adjusted_score", "is_stale", "recommendation",
                    co.completeness(["country", "lead_asset", "runway_quarters", "score"]).alias("completeness"),
                    F.array_join(co.priority_actions(F.col("runway_quarters"), F.col("n_cat"), F.col("score")), "|").alias("actions"),
                    urg.alias("urgency"), expired.alias("expired"))


@query("B22", "watchlist_filters", f"""SELECT c.company_id, ticker FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id
WHERE (lead_area IN ('oncology', 'metabolic') OR list_has_any(coalesce(areas, []), ['oncology', 'metabolic']))
  AND CASE WHEN ma_score >= 80 THEN 'x' WHEN ma_score >= 65 THEN 'x' WHEN ma_score >= 45 THEN 'medium' ELSE 'x' END = 'medium'""")
def _wl_filters(t):
    d = universe(t).withColumnRenamed("ma_score", "score").withColumn("confidence", F.lit(1.0)).withColumn(
        "calculated_at", F.lit(NOW).cast("timestamp_ntz"))
    return co.watchlist_filters(co.score_labels(d, NOW), ["oncology", "metabolic"], risk="medium").select("company_id", "ticker")


@query("C1", "digest_signals", f"""SELECT signal_id, ticker, round(confidence, 6) AS significance FROM d_signals s JOIN d_companies c ON c.company_id = s.company_id
WHERE event_date >= TIMESTAMP '2024-01-30' AND event_date < {TS_NOW} AND confidence >= 0.5 ORDER BY confidence DESC, event_date DESC, signal_id LIMIT 100""")
def _digest(t):
    return si.digest_signals(t.signals, t.companies, "2024-01-30", NOW).select("signal_id", "ticker", r(F.col("confidence")).alias("significance"))


CH = lambda k: f"score - last_value(score) OVER (PARTITION BY company_id ORDER BY datediff('day', DATE '2024-01-01', score_date) RANGE BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING)"
X_CHANGE = f"x_ch AS (SELECT *, {CH(1)} AS c1, {CH(7)} AS c7, {CH(14)} AS c14, row_number() OVER (PARTITION BY company_id ORDER BY score_date DESC) rk FROM d_scores)"


@query("C2", "score_movers", f"""WITH {X_CHANGE} SELECT x.company_id, ticker, round(score, 6) AS score, round(c1, 6) AS change_1d
FROM x_ch x JOIN d_companies c ON c.company_id = x.company_id WHERE rk = 1 AND c1 <> 0 ORDER BY abs(c1) DESC, x.company_id LIMIT 20""")
def _movers(t):
    return hi.score_movers(t.scores, t.companies).select("company_id", "ticker", r("score"), r("change_1d"))


@query("C3", "weekly_watchlist", f"""WITH {X_CHANGE}, j AS (SELECT x.company_id, score, c7, fq FROM x_ch x JOIN d_companies c ON c.company_id = x.company_id
  LEFT JOIN (SELECT company_id, min(score_date) fq FROM d_scores WHERE score >= 50 GROUP BY 1) f ON f.company_id = x.company_id WHERE rk = 1)
SELECT * FROM (SELECT 'candidates' AS section, company_id, round(score, 6) AS value FROM j WHERE score >= 50 ORDER BY score DESC, company_id LIMIT 50)
UNION ALL SELECT 'new', company_id, round(score, 6) FROM j WHERE score >= 50 AND fq >= DATE '2024-01-02' AND fq < DATE '2024-01-31'
UNION ALL SELECT * FROM (SELECT 'improved', company_id, round(c7, 6) FROM j WHERE c7 >= 10 ORDER BY c7 DESC, company_id LIMIT 10)
UNION ALL SELECT 'average', NULL, {sql_tidy('avg(score)', 6)} FROM x_ch WHERE rk = 1 AND score >= 50""")
def _weekly(t):
    p = hi.weekly_watchlist(t.scores, t.companies, "2024-01-02", "2024-01-31")
    row = lambda k, c: p[k].select(F.lit(k).alias("section"), "company_id", r(F.col(c)).alias("value"))
    avg = p["average"].select(F.lit("average").alias("section"), F.lit(None).cast("bigint").alias("company_id"), r(F.col("average_score")).alias("value"))
    return row("candidates", "score").unionByName(row("new", "score")).unionByName(row("improved", "change_7d")).unionByName(avg)


@query("C12", "latest_score_join", """SELECT s.company_id, round(s.score, 6) AS score FROM d_scores s JOIN (SELECT company_id, max(score_date) d FROM d_scores GROUP BY 1) m
ON m.company_id = s.company_id AND m.d = s.score_date WHERE score BETWEEN 30 AND 100 ORDER BY s.score DESC, s.company_id LIMIT 50""")
def _latest_join(t):
    return hi.latest_in_range(t.scores, 30, 100, 50).select("company_id", r("score"))


@query("C13", "signals_by_ids", """SELECT signal_id, company_id FROM d_signals s WHERE EXISTS (SELECT 1 FROM d_regulator g WHERE g.signal_id = s.signal_id AND g.outcome = 'Positive')""")
def _by_ids(t):
    return si.signals_by_ids(t.signals, t.regulator.filter("outcome = 'Positive'")).select("signal_id", "company_id")


WEEK = lambda a, b: f"(SELECT company_id FROM d_scores WHERE score_date >= DATE '{a}' AND score_date < DATE '{b}' GROUP BY 1 HAVING avg(score) >= 45)"


def week_members(t, a, b):
    return (t.scores.filter((F.col("score_date") >= F.lit(a).cast("date")) & (F.col("score_date") < F.lit(b).cast("date")))
            .groupBy("company_id").agg(F.avg("score").alias("m")).filter("m >= 45").select("company_id"))


@query("C14", "watchlist_membership", f"""WITH b AS {WEEK('2024-01-08', '2024-01-15')}, a AS {WEEK('2024-01-15', '2024-01-22')}
SELECT c.company_id, c.company_id IN (SELECT company_id FROM a) AS listed, c.company_id IN (SELECT company_id FROM a) AND c.company_id NOT IN (SELECT company_id FROM b) AS newly_added,
 c.company_id IN (SELECT company_id FROM b) AND c.company_id NOT IN (SELECT company_id FROM a) AS dropped FROM d_companies c""")
def _membership(t):
    b = week_members(t, "2024-01-08", "2024-01-15").withColumn("was", F.lit(True))
    a = week_members(t, "2024-01-15", "2024-01-22").withColumn("now", F.lit(True))
    z = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (t.companies.select("company_id").join(a, "company_id", "left").join(b, "company_id", "left")
            .select("company_id", z("now").alias("listed"), (z("now") & ~z("was")).alias("newly_added"), (z("was") & ~z("now")).alias("dropped")))


@query("H5", "watchlist_diff", f"""WITH b AS {WEEK('2024-01-08', '2024-01-15')}, a AS {WEEK('2024-01-15', '2024-01-22')}
SELECT company_id, 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT company_id, 'removed' FROM (FROM b EXCEPT FROM a)
UNION ALL SELECT company_id, 'retained' FROM (FROM a INTERSECT FROM b)""")
def _diff(t):
    return hi.membership_diff(week_members(t, "2024-01-08", "2024-01-15"), week_members(t, "2024-01-15", "2024-01-22"))


@query("C15", "watchlist_api", """WITH top AS (SELECT company_id, signal_id, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, signal_id) rk FROM d_signals),
j AS (SELECT l.company_id, ticker, ma_score, row_number() OVER (ORDER BY ma_score DESC, l.company_id) AS rank FROM d_latest l JOIN d_companies c ON c.company_id = l.company_id WHERE ma_score >= 30)
SELECT j.company_id, ticker, CAST(rank AS BIGINT) AS rank, round(ma_score, 6) AS ma_score, string_agg(signal_id, '|' ORDER BY rk) AS signals
FROM j LEFT JOIN top ON top.company_id = j.company_id AND rk <= 3 GROUP BY ALL""")
def _wl_api(t):
    from dealsight.functions.scale import positions, top_per_key

    top = top_per_key(t.signals, ["company_id"], [F.col("event_date").desc(), F.col("signal_id")], 3)
    top = top.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "signal_id"))),
                                                                 lambda x: x["signal_id"].cast("string")), "|").alias("signals"))
    hits = universe(t).filter("ma_score >= 30").select("company_id", "ticker", "ma_score")
    ranked = positions(hits, [], [F.col("ma_score").desc(), F.col("company_id")], "rank")
    return ranked.join(top, "company_id", "left").select("company_id", "ticker", "rank", r("ma_score"), "signals")


@query("C18", "previous_score_asof", f"""WITH {X_CHANGE} SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, round(score - c1, 6) AS previous, round(c1, 6) AS change,
  coalesce(abs(c1) > 10, false) AS significant FROM x_ch""")
def _prev_asof(t):
    return hi.previous_asof(t.scores).select("company_id", s("score_date"), r("previous"), r("change"), "significant")


@query("D1", "company_statistics", f"""WITH {X_DER} SELECT count(*) AS total_companies, round(avg(market_cap), 2) AS avg_market_cap, round(sum(market_cap), 2) AS total_market_cap,
  count(*) FILTER (WHERE runway_quarters < 4) AS cash_constrained_count FROM x_der""")
def _stats(t):
    return co.company_statistics(t.companies).select("total_companies", r("avg_market_cap", 2), r("total_market_cap", 2), n("cash_constrained_count"))


@query("D2", "signal_count_by_type", "SELECT signal_type, count(*) AS count FROM d_signals WHERE event_date >= TIMESTAMP '2024-01-10' GROUP BY 1")
def _count(t):
    return si.count_by_type(t.signals, "2024-01-10")


ROLL = f"""x_roll AS (SELECT company_id, count(*) AS total, count(*) AS active, count(*) FILTER (WHERE phase IN ('phase_1', 'phase_2', 'phase_3')) AS clinical,
  count(*) FILTER (WHERE phase IN ('phase_2', 'phase_3', 'nda_bla')) AS late_stage, count(*) FILTER (WHERE phase = 'approved') AS approved,
  count(DISTINCT area) AS diversity, {sql_tidy('sum(CAST(' + sql_lookup('phase', co.PHASE_POINTS, 0) + ' AS DOUBLE)) / count(*)')} AS avg_phase_score, sum(peak_sales) AS potential
  FROM d_assets GROUP BY company_id)"""


@query("D18", "asset_rollup", f"""WITH {ROLL} SELECT company_id, total, active, clinical, late_stage, approved, diversity, avg_phase_score, round(potential, 0) AS potential,
  {sql_tidy('least(10e0, least(clinical / 5e0, 1) * 3 + least(late_stage / 3e0, 1) * 3 + avg_phase_score / 10 * 2.5 + least(diversity / 3e0, 1) * 1.5)')} AS strength FROM x_roll""")
def _rollup(t):
    return co.asset_rollup(t.assets).select("company_id", "total", n("active"), n("clinical"), n("late_stage"), n("approved"),
                                            "diversity", "avg_phase_score", r("potential", 0), "strength")


@query("D31", "profile_signal_rollup", f"""SELECT company_id, signal_type, round(avg(value), 6) AS avg_value, count(*) AS n,
  count(*) OVER (PARTITION BY company_id) >= 3 AS rescore FROM d_signals WHERE event_date >= {TS_NOW} - INTERVAL 20 DAY GROUP BY 1, 2""")
def _type_rollup(t):
    return si.type_rollup(t.signals, NOW, 20).select("company_id", "signal_type", r("avg_value"), "n", "rescore")


@query("D33", "digest_stats", """SELECT signal_type, severity, count(*) AS signals, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_priority,
  count(DISTINCT company_id) AS companies, round(count(*) / count(DISTINCT company_id), 6) AS per_company FROM d_signals GROUP BY ROLLUP (signal_type, severity)""")
def _digest_stats(t):
    return si.digest_stats(t.signals).select("signal_type", "severity", "signals", n("high_priority"), "companies", r("per_company"))


@query("F1", "score_trend", """SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, round(coalesce(c, 0), 6) AS change,
  CASE WHEN c IS NULL OR abs(c) < 2 THEN 'stable' WHEN c > 0 THEN 'up' ELSE 'down' END AS trend
FROM (SELECT *, score - lag(score) OVER (PARTITION BY company_id ORDER BY score_date) AS c FROM d_scores) x""")
def _trend(t):
    return hi.score_trend(t.scores).select("company_id", s("score_date"), r("change"), "trend")


@query("F2", "score_change_30_90", f"""WITH {X_CHANGE} SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, round(c1, 6) AS change_1d, round(c7, 6) AS change_7d, round(c14, 6) AS change_14d FROM x_ch""")
def _changes(t):
    return hi.change_over(t.scores, [1, 7, 14]).select("company_id", s("score_date"), r("change_1d"), r("change_7d"), r("change_14d"))


@query("F3", "score_history", """SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, round(score, 6) AS score, rk AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY company_id ORDER BY score_date DESC) rk FROM d_scores WHERE score_date >= DATE '2024-01-11') x WHERE rk <= 10""")
def _history(t):
    return hi.score_history(t.scores, NOW[:10], 20, 10).select("company_id", s("score_date"), r("score"), n("rank"))


@query("F4", "percentile_ranks", f"""SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, CASE WHEN n > 1 THEN {sql_tidy('(rk - 1) / (n - 1) * 100')} ELSE 50e0 END AS percentile
FROM (SELECT *, row_number() OVER (PARTITION BY score_date ORDER BY score, company_id) rk, count(*) OVER (PARTITION BY score_date) n FROM d_scores) x""")
def _percentile(t):
    return hi.percentile_ranks(t.scores).select("company_id", s("score_date"), "percentile")


@query("F5", "latest_per_key", "SELECT company_id, round(ma_score, 6) AS score, CAST(score_date AS VARCHAR) AS score_date FROM d_latest")
def _latest(t):
    return hi.latest(t.scores).select("company_id", r("score"), s("score_date"))


@query("F10", "watchlist_rerank", """SELECT area AS watchlist, company_id, rk AS rank, round((n - rk + 1) / n * 100, 6) AS percentile FROM (
  SELECT lead_area AS area, c.company_id, row_number() OVER (PARTITION BY lead_area ORDER BY ma_score DESC, c.company_id) rk, count(*) OVER (PARTITION BY lead_area) n
  FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id) x""")
def _rerank(t):
    e = t.companies.join(t.latest, "company_id").select(F.col("lead_area").alias("watchlist"), "company_id", "ma_score")
    return hi.rerank(e, ["watchlist"], "ma_score", "company_id").select("watchlist", "company_id", "rank", r("percentile"))


@query("F11", "sustained_below", """SELECT company_id, CAST(min(score_date) AS VARCHAR) AS start_date, CAST(max(score_date) AS VARCHAR) AS end_date, count(*) AS days FROM (
  SELECT company_id, score_date, datediff('day', DATE '2024-01-01', score_date) - row_number() OVER (PARTITION BY company_id ORDER BY score_date) g FROM d_scores WHERE score < 50) x
GROUP BY company_id, g HAVING count(*) >= 3""")
def _sustained(t):
    d = hi.sustained_below(t.scores, 50, 3)
    return d.select("company_id", F.col("start").cast("string").alias("start_date"), F.col("end").cast("string").alias("end_date"), "days")


@query("F12", "score_volatility", """SELECT company_id, round(stddev_samp(c), 6) AS volatility, coalesce(stddev_samp(c) > 15, false) AS flag FROM (
  SELECT company_id, m - lag(m) OVER (PARTITION BY company_id ORDER BY p) c FROM (SELECT company_id, date_trunc('week', score_date) p, avg(score) m FROM d_scores GROUP BY 1, 2)) x GROUP BY 1""")
def _volatility(t):
    return hi.score_volatility(t.scores, "week").select("company_id", r("volatility"), "flag")


@query("F13", "market_history_90d", f"""SELECT signal_id, company_id, round(value, 6) AS value FROM d_signals WHERE event_date >= {TS_NOW} - INTERVAL 90 DAY AND event_date >= {TS_NOW} - INTERVAL 10 DAY""")
def _market_history(t):
    kept = si.recent_signals(t.signals, NOW, 90)  # retention window
    return si.recent_signals(kept, NOW, 10).select("signal_id", "company_id", r("value"))


@query("G1", "top_scored", "SELECT company_id, round(ma_score, 6) AS ma_score FROM d_latest WHERE ma_score >= 20 ORDER BY d_latest.ma_score DESC, company_id LIMIT 20")
def _top(t):
    return co.top_scored(t.latest, 20, 20).select("company_id", r("ma_score"))


@query("G2", "top_candidates", """WITH p AS (SELECT company_id, signal_type, round(avg(value), 6) AS v FROM d_signals GROUP BY 1, 2),
q AS (SELECT company_id, string_agg(signal_type, '|' ORDER BY v DESC, signal_type DESC) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY v DESC, signal_type DESC) rk FROM p) z WHERE rk <= 3 GROUP BY 1)
SELECT c.company_id, round(ma_score, 6) AS ma_score, parts FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id JOIN q ON q.company_id = c.company_id
WHERE list_contains(areas, 'oncology') ORDER BY l.ma_score DESC, c.company_id LIMIT 10""")
def _candidates(t):
    parts = (t.signals.groupBy("company_id", "signal_type").agg(F.round(F.avg("value"), 6).alias("v"))
             .groupBy("company_id").agg(F.collect_list(F.struct("v", "signal_type")).alias("p")))  # one entry per signal type
    d = co.top_candidates(universe(t).join(parts, "company_id"), 10, "oncology")
    return d.select("company_id", r("ma_score"), F.array_join(F.transform(co.top_parts(F.col("p")), lambda x: x["signal_type"]), "|").alias("parts"))


@query("G3", "sort_nulls_last", """SELECT company_id, round(score, 6) AS score FROM (SELECT c.company_id, CASE WHEN nation_no % 5 <> 0 THEN ma_score END AS score
  FROM d_companies c LEFT JOIN d_latest l ON l.company_id = c.company_id) x""")
def _nulls_last(t):
    d = universe(t).withColumn("score", F.when(F.col("nation_no") % 5 != 0, F.col("ma_score")))
    return co.sorted_nulls_last(d).select("company_id", r("score"))


@query("G5", "paging", """SELECT company_id, ticker, (SELECT count(*) FROM d_companies) AS total, 60 < (SELECT count(*) FROM d_companies) AS has_more
FROM d_companies ORDER BY name, company_id LIMIT 20 OFFSET 40""")
def _paging(t):
    return co.page(t.companies, [F.col("name"), F.col("company_id")], 3, 20).select("company_id", "ticker", n("total"), "has_more")


@query("G6", "filing_history_page", """SELECT o_orderkey AS report_id, CAST(o_orderdate AS VARCHAR)[1:10] AS report_date FROM orders WHERE o_orderpriority = '1-URGENT'
 AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def _filed(t):
    rep = t.orders.select(F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("report_date"))
    return co.filed_page(rep, "1-URGENT", "1997-01-01", "1999-12-31", 50).select("report_id", F.col("report_date").cast("date").cast("string").alias("report_date"))


@query("H7", "watchlist_merge", """WITH snap AS (SELECT lead_area AS watchlist, ticker, ma_score AS score FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id WHERE ma_score >= 40),
chg AS (SELECT lead_area AS watchlist, ticker, signal_id AS seq, CASE WHEN k % 3 = 0 THEN 'add' WHEN k % 3 = 1 THEN 'update' ELSE 'remove' END AS action, least(100e0, value) AS score
  FROM d_signals s JOIN d_companies c ON c.company_id = s.company_id WHERE severity = 'critical'),
lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watchlist, ticker ORDER BY seq DESC) rk FROM chg) WHERE rk = 1),
j AS (SELECT coalesce(s.watchlist, l.watchlist) AS watchlist, coalesce(s.ticker, l.ticker) AS ticker,
   CASE WHEN action = 'add' AND s.score IS NOT NULL THEN 'duplicate_add' WHEN action = 'add' THEN 'added' WHEN action = 'update' AND s.score IS NOT NULL THEN 'updated'
        WHEN action = 'remove' THEN 'removed' WHEN s.score IS NULL THEN 'ignored' ELSE 'kept' END AS status, s.score AS old, l.score AS new
  FROM snap s FULL JOIN lastc l ON l.watchlist = s.watchlist AND l.ticker = s.ticker),
f AS (SELECT watchlist, ticker, status, CASE WHEN status IN ('added', 'updated') THEN coalesce(new, old) ELSE old END AS score FROM j WHERE status NOT IN ('removed', 'ignored'))
SELECT watchlist, ticker, status, round(score, 6) AS score, row_number() OVER (PARTITION BY watchlist ORDER BY score DESC, ticker) AS rank FROM f""")
def _merge(t):
    u = universe(t)
    snap = u.filter("ma_score >= 40").select(F.col("lead_area").alias("watchlist"), "ticker", F.col("ma_score").alias("score"))
    chg = (t.signals.filter("severity = 'critical'").join(t.companies.select("company_id", "ticker", "lead_area"), "company_id")
           .select(F.col("lead_area").alias("watchlist"), "ticker", F.col("signal_id").alias("seq"),
                   F.expr("CASE WHEN k % 3 = 0 THEN 'add' WHEN k % 3 = 1 THEN 'update' ELSE 'remove' END").alias("action"),
                   F.least(F.lit(100.0), "value").alias("score")))
    return hi.watchlist_merge(snap, chg).select("watchlist", "ticker", "status", r("score"), "rank")


@query("C23", "deep_dive_bundle", f"""WITH s AS (SELECT company_id, count(*) AS signals, min(signal_id) AS oldest_signal FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, signal_id) rk FROM d_signals) WHERE rk <= 50 GROUP BY 1),
p AS (SELECT company_id, count(*) AS patents, CAST(min(expiry_date) AS VARCHAR)[1:10] AS patent_floor FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY expiry_date DESC, patent_id) rk FROM d_patents) WHERE rk <= 20 GROUP BY 1),
f AS (SELECT company_id, count(*) AS periods, round(sum(cash), 2) AS cash FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY as_of_date DESC) rk FROM d_financials) WHERE rk <= 8 GROUP BY 1),
h AS (SELECT company_id, count(*) AS history FROM d_scores WHERE score_date >= DATE '2023-11-02' GROUP BY 1),
a AS (SELECT company_id, count(*) AS assets FROM d_assets GROUP BY 1)
SELECT c.company_id, signals, oldest_signal, patents, patent_floor, periods, f.cash, history, assets, round(ma_score, 6) AS ma_score FROM d_companies c
LEFT JOIN s ON s.company_id = c.company_id LEFT JOIN p ON p.company_id = c.company_id LEFT JOIN f ON f.company_id = c.company_id
LEFT JOIN h ON h.company_id = c.company_id LEFT JOIN a ON a.company_id = c.company_id LEFT JOIN d_latest l ON l.company_id = c.company_id""")
def _deep_dive(t):
    from dealsight.operators.profile import deep_dive

    d = deep_dive(t.companies, t.latest, t.assets, t.signals, t.patents, t.financials, t.scores, NOW[:10])
    return d.select("company_id", F.size("signals").cast("bigint").alias("signals"), F.array_min(F.transform("signals", lambda x: x["signal_id"])).alias("oldest_signal"),
                    F.size("patents").cast("bigint").alias("patents"),
                    F.array_min(F.transform("patents", lambda x: x["expiry_date"])).cast("date").cast("string").alias("patent_floor"),
                    F.size("financials").cast("bigint").alias("periods"),
                    r(F.aggregate(F.transform("financials", lambda x: x["cash"]), F.lit(0.0), lambda a, b: a + b), 2).alias("cash"),
                    F.size("history").cast("bigint").alias("history"), n("assets"), r("ma_score"))
