"""Target identification queries."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import DEAL_AS_OF as DEAL
from dealsight.functions.bands import sql_at_least, sql_below, sql_lookup
from dealsight.operators import targets as op
from dealsight.plans.catalog import join_list, n, query, r
from dealsight.plans.scoring import DAYS, TS_DEAL

AREAS = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
HAS = lambda xs: f"list_has_any(coalesce(therapeutic_areas, []), {AREAS(xs)})"
SCREEN = f"""x_run AS (SELECT *, CASE WHEN quarterly_burn_rate <= 0 THEN 999e0 ELSE cash_position / (quarterly_burn_rate / 3) END AS run FROM d_universe),
x_gates AS (SELECT *, market_cap BETWEEN 5e8 AND 5e10 AS g1, lead_asset IS NOT NULL AND lead_rank >= 2 AND total_assets >= 1 AS g2,
  run >= 12 AND (run <= 36 OR {HAS(op.HOT_AREAS)} OR is_platform OR lead_rank >= 3) AS g3,
  {HAS(op.PRIORITY_AREAS)} AND region IN ('North America', 'Europe', 'Asia') AND stock_return_52w >= -80 AND institutional_ownership BETWEEN 0.2e0 AND 0.95e0 AS g4,
  NOT ((lead_rank = 0 AND total_assets = 1) OR is_royalty OR {DAYS('ipo_date', TS_DEAL)} / 30 < 12) AS g5 FROM x_run)"""
INB = lambda x, arms, d: "CASE " + " ".join(f"WHEN {c.replace('#', x)} THEN {v}" for c, v in arms) + f" ELSE {d} END"
RUNWAY = INB("run", [("# >= 12 AND # <= 18", 100), ("# > 18 AND # <= 24", 90), ("# >= 9 AND # < 12", 80), ("# > 24 AND # <= 36", 70), ("# >= 6 AND # < 9", 60), ("# > 36 AND # <= 48", 50)], 30)
CAPFIT = INB("(market_cap / 1e9)", [("# >= 1 AND # <= 5", 100), ("# > 5 AND # <= 10", 90), ("# > 10 AND # <= 15", 75), ("# >= 0.5 AND # < 1", 85), ("# > 15 AND # <= 25", 60), ("# > 25 AND # <= 50", 40)], 20)
DISTRESS = INB("stock_return_52w", [("# >= -40 AND # <= -20", 40), ("# >= -60 AND # < -40", 35), ("# >= -20 AND # < 0", 30), ("# < -60", 20)], 10) \
    + " + " + INB("run", [("# >= 12 AND # <= 18", 30), ("# > 18 AND # <= 24", 25), ("# < 12", 15)], 10) + " + 20"
FACTORS = f"""x_f AS (SELECT *,
  CAST(least(100, least(total_assets * 10, 30) + 0.4e0 * {sql_lookup('lead_asset_phase', op.QUALITY_BY_PHASE, 0)} + 36) AS DOUBLE) AS pipeline_quality,
  CAST({CAPFIT} AS DOUBLE) AS market_cap_fit, CAST({RUNWAY} AS DOUBLE) AS cash_runway,
  CAST(coalesce(list_max(list_transform(therapeutic_areas, lambda a: {sql_lookup('a', op.AREA_SCORE, 40)})), 30) AS DOUBLE) AS therapeutic_area,
  CAST({sql_lookup('lead_asset_phase', op.STAGE_SCORE, 30)} AS DOUBLE) AS clinical_stage, CAST(least(100, {DISTRESS}) AS DOUBLE) AS financial_distress,
  35e0 AS scientific_differentiation,
  CAST(30 + CASE WHEN has_takeover_rumors THEN 15 ELSE 0 END + CASE WHEN has_activist_investor THEN 10 ELSE 0 END AS DOUBLE) AS acquisition_tension,
  35e0 AS strategic_acquirer_fit, 60e0 AS data_catalyst_timing, 65e0 AS competitive_landscape,
  CAST(70 + CASE WHEN institutional_ownership >= 0.7e0 THEN 15 WHEN institutional_ownership < 0.3e0 THEN -10 ELSE 0 END AS DOUBLE) AS deal_structure_feasibility
  FROM x_gates WHERE g1 AND g2 AND g3 AND g4 AND g5)"""
NAMES = list(op.RANKING_WEIGHTS)
ENTRY = "[" + ", ".join(f"{{'k': {k}, 'i': {i}, 't': '{k.replace('_', ' ').title()}'}}" for i, k in enumerate(NAMES)) + "]"
RANKED = f"""{SCREEN}, {FACTORS}, x_c AS (SELECT *, round({' + '.join(f'{k} * {w}e0' for k, w in op.RANKING_WEIGHTS.items())}, 9) AS composite FROM x_f),
x_r AS (SELECT *, row_number() OVER (ORDER BY composite DESC, ticker) AS rank, count(*) OVER () AS n,
  least(0.85e0, composite / 100 * 0.5e0 + {sql_below('run', [(15, 0.2), (24, 0.15), (36, 0.05)], 0)} + CASE WHEN stock_return_52w < -40 THEN 0.1 ELSE 0 END
    + CASE WHEN has_activist_investor THEN 0.15 ELSE 0 END + CASE WHEN has_takeover_rumors THEN 0.1 ELSE 0 END) AS p12 FROM x_c)"""


# the identification job ranks on the profile alone, so the tension factor has no flags
IDENTIFIED = RANKED.replace("CAST(30 + CASE WHEN has_takeover_rumors THEN 15 ELSE 0 END + CASE WHEN has_activist_investor THEN 10 ELSE 0 END AS DOUBLE) AS acquisition_tension", "30e0 AS acquisition_tension")


def screened(t):
    return op.screen(t.universe, DEAL)


def ranked(t):
    return op.rank_targets(op.readiness_factors(screened(t).filter("passed")))


@query("B10", "screen_waterfall", f"""WITH {SCREEN} SELECT company_id, CASE WHEN NOT g1 THEN 'market_cap' WHEN NOT g2 THEN 'assets' WHEN NOT g3 THEN 'finance' WHEN NOT g4 THEN 'strategy' WHEN NOT g5 THEN 'exclusions' END AS failed_gate,
  g1 AND g2 AND g3 AND g4 AND g5 AS passed, round(run, 6) AS runway_months FROM x_gates""")
def _screen(t):
    return screened(t).select("company_id", "failed_gate", "passed", r(F.col("cash_runway_months")).alias("runway_months"))


@query("B11", "screen_funnel", f"""WITH {SCREEN} SELECT count(*) AS reviewed, count(*) FILTER (WHERE g1) AS passed_market_cap, count(*) FILTER (WHERE g1 AND g2) AS passed_assets,
  count(*) FILTER (WHERE g1 AND g2 AND g3) AS passed_finance, count(*) FILTER (WHERE g1 AND g2 AND g3 AND g4) AS passed_strategy,
  count(*) FILTER (WHERE g1 AND g2 AND g3 AND g4 AND g5) AS passed_exclusions, round(count(*) FILTER (WHERE g1 AND g2 AND g3 AND g4 AND g5) / count(*), 6) AS pass_rate FROM x_gates""")
def _funnel(t):
    d = op.screen_funnel(screened(t))
    return d.select("reviewed", *[n(f"passed_{g}") for g in op.GATES], r("pass_rate"))


@query("B12", "priority_targets", f"""WITH {SCREEN} SELECT company_id, ticker FROM x_gates WHERE g1 AND g2 AND g3 AND g4 AND g5 AND {HAS(['oncology_adc', 'rare_disease'])} AND (run < 24 OR lead_rank >= 3 OR run < 18 OR stock_return_52w < -50)""")
def _priority(t):
    return op.priority_targets(screened(t), ["oncology_adc", "rare_disease"]).select("company_id", "ticker")


@query("E12", "deal_readiness_factors", f"WITH {SCREEN}, {FACTORS} SELECT company_id, {', '.join(NAMES)} FROM x_f".replace("WHERE g1 AND g2 AND g3 AND g4 AND g5", "").replace(
    ", pipeline_quality,", ", round(pipeline_quality, 6) AS pipeline_quality,"))
def _factors(t):
    return op.readiness_factors(op.with_runway(t.universe)).select("company_id", *[r(k) for k in NAMES])


@query("E13", "target_ranking", f"""WITH {RANKED} SELECT company_id, round(composite, 6) AS composite, rank, round((n - rank + 1) / n * 100, 6) AS percentile,
  array_to_string(list_transform(list_filter(list_sort(list_transform({ENTRY}, lambda e: {{'k': -e.k, 'i': e.i, 't': e.t}}))[1:3], lambda e: -e.k >= 70), lambda e: e.t || ' (' || CAST(-e.k AS INT) || '/100)'), '|') AS strengths,
  array_to_string(list_transform(list_filter(list_sort({ENTRY})[1:3], lambda e: e.k <= 50), lambda e: e.t || ' (' || CAST(e.k AS INT) || '/100)'), '|') AS weaknesses,
  name || ' (' || ticker || ') is a $' || printf('%.1f', market_cap / 1e9) || 'B ' || replace(first_area, '_', ' ') || ' company with a ' || lead_asset_phase || ' lead asset. Strategic fit and timing make it an attractive M&A target.' AS thesis FROM x_r""")
def _ranking(t):
    return ranked(t).select("company_id", r("composite"), "rank", r("percentile"), join_list("key_strengths", "strengths"),
                            join_list("key_weaknesses", "weaknesses"), "thesis")


@query("E14", "deal_probability", f"""WITH {RANKED} SELECT company_id, round(p12, 6) AS probability_12mo, round(least(0.95e0, p12 * 1.6e0), 6) AS probability_24mo,
  round(market_cap * 1.3e0, 2) AS value_low, round(market_cap * 1.5e0, 2) AS value_base, round(market_cap * 1.8e0, 2) AS value_high FROM x_r""")
def _probability(t):
    d = op.deal_probability(ranked(t))
    return d.select("company_id", r("probability_12mo"), r("probability_24mo"), r("value_low", 2), r("value_base", 2), r("value_high", 2))


BUYERS = "x_b(area, seq, bname, fit) AS (VALUES " + ", ".join(
    f"('{a}', {i}, '{b[0]}', {float(b[2])}e0)" for a, bs in {**op.LIKELY_BUYERS, '': op.DEFAULT_BUYERS}.items() for i, b in enumerate(bs)) + ")"
BUYER_JOIN = "JOIN x_b b ON b.area = CASE WHEN first_area IN (SELECT area FROM x_b) THEN first_area ELSE '' END"


@query("E15", "area_acquirers", f"""WITH {BUYERS} SELECT company_id, string_agg(bname, '|' ORDER BY seq) AS acquirers, max_by(bname, fit) AS top_acquirer,
  round(max(fit) / 100 * 0.4e0, 6) AS probability, round(40 + max(fit) / 100 * 20, 6) AS premium FROM d_universe {BUYER_JOIN} GROUP BY company_id""")
def _area_acquirers(t):
    d = op.area_acquirers(t.universe, op.buyers_table(t.spark))
    return d.select("company_id", F.array_join(F.transform("acquirers", lambda a: a["name"]), "|").alias("acquirers"),
                    F.col("top_acquirer.name").alias("top_acquirer"), r(F.col("top_acquirer.probability")).alias("probability"),
                    r(F.col("top_acquirer.premium")).alias("premium"))


@query("E16", "next_catalyst", f"""SELECT company_id, event_type, CAST({DAYS(TS_DEAL, 'expected_date')} AS BIGINT) AS days_until FROM (
  SELECT o_orderkey % (SELECT count(*) FROM supplier) AS company_id, o_orderpriority AS event_type, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 5 YEAR END AS expected_date,
    row_number() OVER (PARTITION BY o_orderkey % (SELECT count(*) FROM supplier) ORDER BY coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 5 YEAR END, TIMESTAMP '9999-12-31'), o_orderkey) rk
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate + INTERVAL 5 YEAR >= {TS_DEAL}) x WHERE rk = 1""")
def _catalyst(t):
    o = t.deals.join(t.orders.select(F.col("o_orderkey").alias("deal_id"), "o_orderpriority", "o_orderstatus", "o_orderdate"), "deal_id")
    when = F.col("o_orderdate") + F.expr("INTERVAL 5 YEARS")
    c = (o.filter(when >= F.lit(DEAL).cast("timestamp_ntz"))
         .select(F.col("target_id").alias("company_id"), F.col("deal_id").alias("catalyst_id"), F.col("o_orderpriority").alias("event_type"),
                 F.when(F.col("o_orderstatus") != "P", when).alias("expected_date"),
                 F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").when(F.col("o_orderpriority") == "2-HIGH", "High").otherwise("Low").alias("importance")))
    return op.next_catalyst(c, DEAL).drop("expected_date")


@query("C22", "universe_lookup", f"WITH {IDENTIFIED} SELECT ticker, rank, round(composite, 6) AS composite, market_cap AS raw_cap, round(p12, 6) AS probability FROM x_r WHERE rank <= 20")
def _identify(t):
    d = op.identify_targets(t.universe, DEAL, top_n=20)
    return d.select("ticker", "rank", r("composite"), "raw_cap", r(F.col("probability_12mo")).alias("probability"))


@query("D30", "watchlist_statistics", f"""WITH {IDENTIFIED} SELECT count(*) AS targets, round(avg(composite), 6) AS avg_score, round(avg(market_cap), 2) AS avg_cap, round(avg(p12), 6) AS avg_probability,
  round(sum(market_cap * 1.5e0), 0) AS total_value, count(DISTINCT first_area) AS areas, count(*) FILTER (WHERE p12 >= 0.4) AS high_probability FROM x_r""")
def _wl_stats(t):
    d = op.identify_targets(t.universe, DEAL, top_n=None).withColumn("area", F.col("first_area"))
    s = op.watchlist_statistics(d)
    return s.select("targets", r("avg_score"), r("avg_cap", 2), r("avg_probability"), r("total_value", 0), "areas", n("high_probability"))
