"""Component scores, weights, composite."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import DEAL_AS_OF as DEAL, EVENT_AS_OF as NOW
from dealsight.functions.bands import sql_above, sql_below, sql_lookup, sql_tidy
from dealsight.functions.clock import sql_decay
from dealsight.functions.scale import cut
from dealsight.operators import components as op
from dealsight.plans.catalog import join_list, n, query, r, s

DAYS = lambda a, b: f"floor((epoch_us({b}) - epoch_us({a})) / 86400000000)"
TS_NOW, TS_DEAL = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{DEAL}'"

# shared check fragments -------------------------------------------------------
ASSET_SCORES = f"""x_asset AS (SELECT company_id, asset_id, least(100e0,
    ({sql_lookup('phase', op.PHASE_VALUE, 0.3)} * 100e0 * {sql_lookup('area', op.AREA_VALUE, 0.5)}
     + CASE WHEN patient_population = 0 THEN 0 WHEN patient_population > 1000000 THEN 15
            WHEN patient_population > 100000 THEN 10
            WHEN patient_population < 10000 THEN CASE WHEN orphan THEN 5 ELSE -5 END ELSE 0 END
     + CASE WHEN breakthrough THEN 15 ELSE 0 END + CASE WHEN orphan THEN 10 ELSE 0 END
     + CASE WHEN fast_track THEN 8 ELSE 0 END + CASE WHEN priority_review THEN 5 ELSE 0 END)
    * ({sql_decay(DAYS('last_update', TS_DEAL), 30e0)})) AS sc FROM d_assets WHERE is_active)"""
ASSET_COMPONENT = f"""x_asset_rk AS (SELECT company_id, sc, row_number() OVER (PARTITION BY company_id ORDER BY sc DESC) rk,
    count(*) OVER (PARTITION BY company_id) n FROM x_asset),
x_pipeline AS (SELECT company_id, max(n) AS signals, {sql_tidy('''least(100e0, sum(CASE
      WHEN n = 1 THEN CASE WHEN rk = 1 THEN sc ELSE 0 END
      WHEN n = 2 THEN CASE rk WHEN 1 THEN sc * 0.6e0 ELSE sc * 0.4e0 END
      ELSE CASE rk WHEN 1 THEN sc * 0.5e0 WHEN 2 THEN sc * 0.3e0 WHEN 3 THEN sc * 0.2e0 ELSE 0 END END)
      + least(15, max(n) * 2))''')} AS score FROM x_asset_rk GROUP BY company_id)"""


def patent_sql(key):
    return f"""x_pat AS (SELECT {key}, least(100e0, {sql_below('yrs', op.PATENT_LIFE, 60)}
      * CASE WHEN is_composition THEN 1.5e0 WHEN is_method THEN 1e0 WHEN is_formulation THEN 0.8e0 ELSE 1e0 END
      + least(30, claims_count * 2) + least(20, citations_count * 3)) AS sc
    FROM (SELECT *, {DAYS(TS_DEAL, 'expiry_date')} / 365.25e0 AS yrs FROM d_patents WHERE expiry_date >= {TS_DEAL}) q),
x_pat_rk AS (SELECT {key}, sc, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC) rk,
    count(*) OVER (PARTITION BY {key}) n FROM x_pat),
x_patent AS (SELECT {key}, max(n) AS signals, {sql_tidy('''least(100e0, sum(CASE
      WHEN n = 1 THEN sc
      WHEN n < 4 THEN CASE rk WHEN 1 THEN sc * 0.5e0 WHEN 2 THEN sc * 0.3e0 ELSE sc * 0.2e0 END
      ELSE CASE rk WHEN 1 THEN sc * 0.4e0 WHEN 2 THEN sc * 0.3e0 WHEN 3 THEN sc * 0.2e0 WHEN 4 THEN sc * 0.1e0 ELSE 0 END END)
      + least(20, max(n) * 3))''')} AS score FROM x_pat_rk GROUP BY {key})"""


FINANCIAL = f"""x_fin0 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY as_of_date DESC) rk FROM d_financials),
x_fin1 AS (SELECT *, CASE WHEN burn_rate > 0 THEN cash / burn_rate ELSE 999e0 END AS runway_months,
    {DAYS(TS_DEAL, 'next_catalyst_date')} / 30.4e0 AS months_to_catalyst FROM x_fin0 WHERE rk = 1),
x_financial AS (SELECT company_id, runway_months, months_to_catalyst, CASE WHEN market_cap <= 0 THEN 0e0 ELSE {sql_tidy(f'''least(100e0,
      0.4e0 * {sql_below('runway_months', op.RUNWAY_BAND, 20)}
      + 0.2e0 * CASE WHEN months_to_catalyst > 0 AND months_to_catalyst < runway_months - 3 THEN 10
                   WHEN months_to_catalyst > 0 AND months_to_catalyst < runway_months + 3 THEN 25
                   WHEN months_to_catalyst > runway_months THEN 40 ELSE 0 END
      + 0.3e0 * {sql_below('market_cap', op.CAP_BAND, 10)} + 0.1e0 * {sql_above('revenue', op.REVENUE_BAND, 0)})''')} END AS score
    FROM x_fin1)"""
INSIDER = f"""x_feed AS (
    SELECT company_id, transaction_date AS ts, CASE
      WHEN transaction_type = 'purchase' THEN CASE WHEN is_executive THEN 5 ELSE 3 END + {sql_above('amount', op.PURCHASE_SIZE, 0)}
      WHEN is_planned THEN 0
      ELSE -(CASE WHEN is_executive THEN 3 ELSE 1 END + {sql_above('amount', op.SALE_SIZE, 0)}) END AS pts FROM d_insider
    UNION ALL
    SELECT company_id, filing_date, CASE
      WHEN position_change_pct > 0 THEN CASE WHEN is_activist THEN 8 ELSE 4 END + {sql_above('position_change_pct', [(50, 10), (20, 5)], 0)}
      WHEN position_change_pct < 0 THEN -(CASE WHEN is_activist THEN 6 ELSE 3 END + CASE WHEN position_change_pct < -50 THEN 8 ELSE 0 END)
      ELSE 0 END FROM d_holdings),
x_insider AS (SELECT company_id, count(*) AS signals, max(ts) AS last_updated, {sql_tidy(f'''least(100e0, greatest(0e0,
      50 + sum(pts * ({sql_decay(DAYS('ts', TS_NOW), 30e0)}))))''')} AS score FROM x_feed GROUP BY company_id)"""
ISSUES = """x_issues AS (SELECT company_id, count(*) FILTER (WHERE issue_type = 'clinical_hold') AS holds,
    count(*) FILTER (WHERE issue_type = 'warning_letter') AS warnings FROM d_issues
    WHERE issue_date >= TIMESTAMP '2022-01-31 00:00:00' GROUP BY company_id)"""
PATHWAY = "CASE company_id % 4 WHEN 0 THEN 'BLA' WHEN 1 THEN 'orphan' WHEN 2 THEN 'unclear' ELSE 'de novo' END"
REGULATORY = f"""x_talk AS (SELECT company_id, count(*) AS signals, max(interaction_date) AS last_updated, sum((CASE
      WHEN lower(outcome) LIKE '%positive%' OR lower(outcome) LIKE '%agreement%' THEN
        CASE WHEN lower(interaction_type) LIKE '%spa%' THEN 15 WHEN lower(interaction_type) LIKE '%meeting%' THEN 10 ELSE 5 END
      WHEN lower(outcome) LIKE '%complete response%' THEN -20 ELSE 0 END)
      * ({sql_decay(DAYS('interaction_date', TS_NOW), 30e0)})) AS talk
    FROM d_regulator WHERE interaction_date >= TIMESTAMP '2022-01-31 00:00:00' GROUP BY company_id),
{ISSUES},
x_regulatory AS (SELECT c.company_id, coalesce(t.signals, 0) AS signals, t.last_updated, {sql_tidy(f'''least(100e0, greatest(0e0,
      CASE c.company_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 90 WHEN 2 THEN 40 ELSE 50 END
      + coalesce(talk, 0) - coalesce(holds, 0) * 25 - coalesce(warnings, 0) * 15))''')} AS score
    FROM d_companies c LEFT JOIN x_talk t ON t.company_id = c.company_id LEFT JOIN x_issues i ON i.company_id = c.company_id)"""
FIT = f"""x_top AS (SELECT * FROM d_acquirers WHERE is_active ORDER BY market_cap DESC, acquirer_id LIMIT 5),
x_fit AS (SELECT c.company_id, CASE WHEN len(c.areas) > 0 AND len(a.areas) > 0 THEN {sql_tidy('''least(100e0,
      len(list_intersect(c.areas, a.areas)) / len(c.areas) * 60 * 0.4e0
      + least(40, 20 * coalesce(len(list_filter(a.gaps, lambda g: list_contains(c.areas, g))), 0)) * 0.3e0 + 3e0
      + least(20, 10 * (len(c.areas) - len(list_intersect(c.areas, a.areas)))) * 0.1e0)''')} ELSE 50e0 END AS f
    FROM d_companies c CROSS JOIN x_top a),
x_strategic AS (SELECT company_id, avg(f) AS score, count(*) AS signals FROM x_fit GROUP BY company_id)"""


def pathways(t):
    return t.companies.select("company_id", F.expr(PATHWAY).alias("regulatory_pathway"))


@query("E1", "signal_decay", f"""
SELECT signal_id, CAST({DAYS('event_date', TS_NOW)} AS BIGINT) AS age_days,
  round({sql_decay(DAYS('event_date', TS_NOW), '(CASE signal_type ' + ' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in {'clinical_trial': 60, 'patent': 90, 'financial': 14, 'insider_transaction': 30}.items()) + ' ELSE 30e0 END)')}, 6) AS weight,
  round(value * ({sql_decay(DAYS('event_date', TS_NOW), '(CASE signal_type ' + ' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in {'clinical_trial': 60, 'patent': 90, 'financial': 14, 'insider_transaction': 30}.items()) + ' ELSE 30e0 END)')}), 6) AS decayed
FROM d_signals""")
def _signal_decay(t):
    half = t.spark.createDataFrame([("clinical_trial", 60.0), ("patent", 90.0), ("financial", 14.0),
                                    ("insider_transaction", 30.0)], "signal_type string, half_life double")
    sig = t.signals.join(F.broadcast(half), "signal_type", "left")
    d = op.signal_decay(sig, NOW, F.coalesce("half_life", F.lit(30.0)))
    return d.select("signal_id", n("age_days"), r("weight"), r("decayed"))


@query("E2", "asset_component", f"WITH {ASSET_SCORES}, {ASSET_COMPONENT} SELECT company_id, score, CAST(signals AS BIGINT) AS assets FROM x_pipeline")
def _asset_component(t):
    return op.asset_component(t.assets, DEAL).select("company_id", "score", F.col("signals").alias("assets"))


@query("E3", "patent_component", f"WITH {patent_sql('family_id')} SELECT family_id, score, CAST(signals AS BIGINT) AS patents FROM x_patent")
def _patent_component(t):
    return op.patent_component(t.patents, DEAL, "family_id").select("family_id", "score", F.col("signals").alias("patents"))


@query("E4", "financial_component", f"""WITH {FINANCIAL} SELECT company_id, score, round(runway_months, 6) AS runway_months,
  round(months_to_catalyst, 6) AS months_to_catalyst FROM x_financial""")
def _financial_component(t):
    return op.financial_component(t.financials, DEAL).select("company_id", "score", r("runway_months"), r("months_to_catalyst"))


@query("E5", "insider_component", f"WITH {INSIDER} SELECT company_id, score, CAST(signals AS BIGINT) AS signals FROM x_insider")
def _insider_component(t):
    return op.insider_component(t.insider, t.holdings, NOW).select("company_id", "score", "signals")


@query("D3", "regulatory_issue_counts", f"""WITH {ISSUES} SELECT company_id, CAST(holds AS BIGINT) AS clinical_holds,
  CAST(warnings AS BIGINT) AS warning_letters FROM x_issues""")
def _issues(t):
    return op.issue_counts(t.issues, NOW)


@query("E6", "regulatory_component", f"WITH {REGULATORY} SELECT company_id, score, CAST(signals AS BIGINT) AS interactions FROM x_regulatory")
def _regulatory(t):
    d = op.regulatory_component(pathways(t), t.regulator, t.issues, NOW)
    return d.select("company_id", "score", F.col("signals").alias("interactions"))


@query("E7", "strategic_fit_component", f"WITH {FIT} SELECT company_id, round(score, 6) AS score FROM x_strategic")
def _fit(t):
    return op.strategic_fit_component(t.companies, t.acquirers).select("company_id", r("score"))


@query("E8", "weight_normalize", """
SELECT company_id, signal_type AS component, round(w / sum(w) OVER (PARTITION BY company_id), 6) AS weight
FROM (SELECT company_id, signal_type, count(*) AS w FROM d_signals WHERE signal_type <> 'financial' GROUP BY 1, 2) x""")
def _weights(t):
    # observed signal mix of each company as its weight profile, one component disabled
    w = (t.signals.groupBy("company_id", F.col("signal_type").alias("component"))
         .agg(F.count(F.lit(1)).cast("double").alias("weight"))
         .withColumn("enabled", F.col("component") != "financial"))
    return op.normalize_weights(w, ["company_id"]).select("company_id", "component", r("weight"))


def scored(t):
    # the test tables are views over views: companies are used four times and read once
    companies = cut(t.companies)
    ways = companies.select("company_id", F.expr(PATHWAY).alias("regulatory_pathway"))
    return op.batch_scores(companies, t.assets, t.patents, t.financials, t.insider, t.holdings, ways,
                           t.regulator, t.issues, t.acquirers, op.weights_table(t.spark), DEAL, NOW)


COMPOSITE = f"""{ASSET_SCORES}, {ASSET_COMPONENT}, {patent_sql('company_id')}, {FINANCIAL}, {INSIDER}, {REGULATORY}, {FIT},
x_long AS (
  SELECT c.company_id, 'pipeline' AS component, 0.30e0 AS w, coalesce(score, 0e0) AS score, coalesce(signals, 0) AS signals, CAST(NULL AS TIMESTAMP) AS lu FROM d_companies c LEFT JOIN x_pipeline p ON p.company_id = c.company_id
  UNION ALL SELECT c.company_id, 'patent', 0.20e0, coalesce(score, 0e0), coalesce(signals, 0), NULL FROM d_companies c LEFT JOIN x_patent p ON p.company_id = c.company_id
  UNION ALL SELECT c.company_id, 'financial', 0.15e0, coalesce(score, 0e0), 1, NULL FROM d_companies c LEFT JOIN x_financial p ON p.company_id = c.company_id
  UNION ALL SELECT c.company_id, 'insider', 0.15e0, coalesce(score, 50e0), coalesce(signals, 0), last_updated FROM d_companies c LEFT JOIN x_insider p ON p.company_id = c.company_id
  UNION ALL SELECT company_id, 'strategic_fit', 0.10e0, score, signals, NULL FROM x_strategic
  UNION ALL SELECT company_id, 'regulatory', 0.10e0, score, signals, last_updated FROM x_regulatory),
x_composite AS (SELECT company_id, {sql_tidy('least(100e0, greatest(0e0, sum(score * w)))')} AS overall_score,
  {sql_tidy(f'''least(1e0, greatest(0.1e0, least(0.4e0, sum(signals) / 50e0)
     + 0.3e0 * coalesce(avg(greatest(0e0, 1 - {DAYS('lu', TS_NOW)} / 90e0)) FILTER (WHERE lu IS NOT NULL), 0e0)
     + 0.3e0 * greatest(0e0, 1 - var_pop(score) / 1000)))''')} AS confidence,
  list_sort(array_agg({{'c': round(score * w, 9), 'n': component, 's': score}}), 'DESC')[1:3] AS top
  FROM x_long GROUP BY company_id)"""


@query("E9", "composite_score", f"""WITH {COMPOSITE}
SELECT company_id, overall_score, array_to_string(list_transform(top, lambda x: x.n), '|') AS drivers,
  array_to_string(list_filter(list_transform(top, lambda x: CASE WHEN x.s >= 70 THEN 'Strong ' || x.n WHEN x.s >= 50 THEN 'Moderate ' || x.n END), lambda y: y IS NOT NULL), '|') AS key_signals
FROM x_composite""")
def _composite(t):
    return scored(t).select("company_id", "overall_score", join_list("drivers"), join_list("key_signals"))


@query("E10", "score_confidence", f"WITH {COMPOSITE} SELECT company_id, confidence FROM x_composite")
def _confidence(t):
    return scored(t).select("company_id", "confidence")


@query("E11", "batch_scores", f"""WITH {COMPOSITE} SELECT c.company_id, ticker, overall_score, confidence
FROM x_composite x JOIN d_companies c ON c.company_id = x.company_id WHERE deleted_at IS NULL""")
def _batch(t):
    alive = t.companies.filter("deleted_at IS NULL").select("company_id", "ticker")
    return scored(t).join(alive, "company_id").select("company_id", "ticker", "overall_score", "confidence")
