"""K1 with the composite rebuilt at each cut-off; the check holds all bands as literals."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import EVENT_AS_OF as NOW
from dealsight.functions.bands import tidy
from dealsight.operators import backtest as bt, components as co
from dealsight.plans.catalog import n, query, s
from dealsight.plans.deals import PAIRS, matches
from dealsight.plans.scoring import pathways
from dealsight.plans.valuing import ANNOUNCED, announcements

# deals and events run on clocks of their own in the test tables: so many days lie between their as-of times
SHIFT_DAYS = -8096


def age(a, b):
    return f"floor((epoch_us({b}) - epoch_us({a})) / 864e8)"


def fade(days):
    return f"CASE WHEN {days} < 7 THEN 1.5e0 ELSE greatest(pow(2e0, -({days}) / 30e0), 0.1e0) END"


def top(source, weights):
    return f"""(SELECT company_id, day, max(n) AS n, sum(sc * CASE {weights} ELSE 0 END) AS base FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id, day ORDER BY sc DESC) AS rk, count(*) OVER (PARTITION BY company_id, day) AS n FROM {source}) q GROUP BY company_id, day)"""


def score(x):
    return f"CAST(round(CAST({x} AS DECIMAL(28,9)), 2) AS DOUBLE)"


ASSET = f"""least(100e0, (CASE phase WHEN 'preclinical' THEN 0.3e0 WHEN 'phase_1' THEN 0.5e0 WHEN 'phase_2' THEN 0.8e0 WHEN 'phase_3' THEN 1e0 WHEN 'nda_bla' THEN 0.9e0 WHEN 'approved' THEN 0.7e0 ELSE 0.3e0 END * 100
    * CASE area WHEN 'oncology' THEN 1e0 WHEN 'rare_disease' THEN 0.95e0 WHEN 'immunology' THEN 0.9e0 WHEN 'neurology' THEN 0.85e0 WHEN 'metabolic' THEN 0.8e0 WHEN 'cardiovascular' THEN 0.75e0 ELSE 0.5e0 END
    + CASE WHEN patient_population = 0 THEN 0 WHEN patient_population > 1000000 THEN 15 WHEN patient_population > 100000 THEN 10 WHEN patient_population < 10000 THEN CASE WHEN orphan THEN 5 ELSE -5 END ELSE 0 END
    + breakthrough::INT * 15 + orphan::INT * 10 + fast_track::INT * 8 + priority_review::INT * 5) * ({fade(age('last_update', 'td'))}))"""
PATENT = """least(100e0, CASE WHEN y < 0 THEN 0 WHEN y < 3 THEN 20 WHEN y < 8 THEN 100 WHEN y < 15 THEN 80 ELSE 60 END * CASE WHEN is_composition THEN 1.5e0 WHEN is_method THEN 1e0 WHEN is_formulation THEN 0.8e0 ELSE 1e0 END
    + least(30, claims_count * 2) + least(20, citations_count * 3))"""
MONEY = """least(100e0, 0.4e0 * CASE WHEN run < 3 THEN 100 WHEN run < 6 THEN 90 WHEN run < 12 THEN 80 WHEN run < 18 THEN 60 WHEN run < 24 THEN 40 ELSE 20 END
    + 0.2e0 * CASE WHEN m > 0 AND m < run - 3 THEN 10 WHEN m > 0 AND m < run + 3 THEN 25 WHEN m > run THEN 40 ELSE 0 END
    + 0.3e0 * CASE WHEN market_cap < 1e8 THEN 100 WHEN market_cap < 3e8 THEN 80 WHEN market_cap < 5e8 THEN 60 WHEN market_cap < 1e9 THEN 40 WHEN market_cap < 2e9 THEN 20 ELSE 10 END
    + 0.1e0 * CASE WHEN revenue > 1e8 THEN 20 WHEN revenue > 5e7 THEN 15 WHEN revenue > 1e7 THEN 10 ELSE 0 END)"""
FIT = """least(100e0, len(list_intersect(c.areas, b.areas)) / len(c.areas) * 60 * 0.4e0
    + least(40, 20 * coalesce(len(list_filter(b.gaps, lambda g: list_contains(c.areas, g))), 0)) * 0.3e0 + 3e0 + least(20, 10 * (len(c.areas) - len(list_intersect(c.areas, b.areas)))) * 0.1e0)"""
REGULATOR = """least(100e0, greatest(0e0, CASE t.company_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 90 WHEN 2 THEN 40 ELSE 50 END + coalesce(talk, 0) - coalesce(holds, 0) * 25 - coalesce(warnings, 0) * 15))"""
CONFIDENCE = f"""least(1e0, greatest(0.1e0, least(0.4e0, sum(signals) / 50e0)
    + 0.3e0 * coalesce(avg(greatest(0e0, 1 - {age('lu', 'CAST(day + 1 AS TIMESTAMP)')} / 90e0)) FILTER (WHERE lu IS NOT NULL), 0e0) + 0.3e0 * greatest(0e0, 1 - var_pop(score) / 1000)))"""
ASSET_WEIGHTS = "WHEN n = 1 AND rk = 1 THEN 1e0 WHEN n = 2 AND rk = 1 THEN 0.6e0 WHEN n = 2 AND rk = 2 THEN 0.4e0 WHEN n > 2 AND rk = 1 THEN 0.5e0 WHEN n > 2 AND rk = 2 THEN 0.3e0 WHEN n > 2 AND rk = 3 THEN 0.2e0"
PATENT_WEIGHTS = "WHEN n = 1 THEN 1e0 WHEN n < 4 AND rk = 1 THEN 0.5e0 WHEN n < 4 AND rk = 2 THEN 0.3e0 WHEN n < 4 THEN 0.2e0 WHEN rk = 1 THEN 0.4e0 WHEN rk = 2 THEN 0.3e0 WHEN rk = 3 THEN 0.2e0 WHEN rk = 4 THEN 0.1e0"
ON = "ON {0}.company_id = t.company_id AND {0}.day = t.day"


#: Every component at (company_id, day) of ``t``, which also has the end of the day on both clocks (te, td).
PARTS = f"""a AS (SELECT t.company_id, day, {ASSET} AS sc FROM t JOIN d_assets x ON x.company_id = t.company_id WHERE is_active AND last_update < td),
ac AS (SELECT company_id, day, n AS signals, {score('least(100e0, base + least(15, n * 2))')} AS score FROM {top('a', ASSET_WEIGHTS)} z),
p AS (SELECT company_id, day, {PATENT} AS sc FROM (SELECT t.company_id, day, x.* EXCLUDE (company_id), {age('td', 'expiry_date')} / 365.25e0 AS y FROM t JOIN d_patents x ON x.company_id = t.company_id WHERE expiry_date >= td) q),
pc AS (SELECT company_id, day, n AS signals, {score('least(100e0, base + least(20, n * 3))')} AS score FROM {top('p', PATENT_WEIGHTS)} z),
f AS (SELECT *, CASE WHEN burn_rate > 0 THEN cash / burn_rate ELSE 999e0 END AS run, {age('td', 'next_catalyst_date')} / 30.4e0 AS m FROM (SELECT t.company_id, t.day, td, x.* EXCLUDE (company_id), row_number() OVER (PARTITION BY t.company_id, day ORDER BY as_of_date DESC) AS rk
  FROM t JOIN d_financials x ON x.company_id = t.company_id AND as_of_date < td) q WHERE rk = 1),
fc AS (SELECT company_id, day, CASE WHEN market_cap <= 0 THEN 0e0 ELSE {score(MONEY)} END AS score FROM f),
i AS (SELECT company_id, transaction_date AS ts, CASE WHEN transaction_type = 'purchase' THEN CASE WHEN is_executive THEN 5 ELSE 3 END + CASE WHEN amount > 1e6 THEN 10 WHEN amount > 5e5 THEN 5 WHEN amount > 1e5 THEN 3 ELSE 0 END
    WHEN is_planned THEN 0 ELSE -(CASE WHEN is_executive THEN 3 ELSE 1 END + CASE WHEN amount > 5e6 THEN 15 WHEN amount > 1e6 THEN 8 WHEN amount > 5e5 THEN 4 ELSE 0 END) END AS pts FROM d_insider
  UNION ALL SELECT company_id, filing_date, CASE WHEN position_change_pct > 0 THEN CASE WHEN is_activist THEN 8 ELSE 4 END + CASE WHEN position_change_pct > 50 THEN 10 WHEN position_change_pct > 20 THEN 5 ELSE 0 END
    WHEN position_change_pct < 0 THEN -(CASE WHEN is_activist THEN 6 ELSE 3 END + CASE WHEN position_change_pct < -50 THEN 8 ELSE 0 END) ELSE 0 END FROM d_holdings),
ic AS (SELECT t.company_id, day, count(*) AS signals, max(ts) AS lu, {score(f"least(100e0, greatest(0e0, 50 + sum(pts * ({fade(age('ts', 'te'))}))))")} AS score FROM t JOIN i ON i.company_id = t.company_id AND ts < te AND ts >= te - INTERVAL 1 YEAR GROUP BY 1, 2),
r AS (SELECT t.company_id, day, count(*) AS signals, max(interaction_date) AS lu, sum(CASE WHEN outcome IN ('Positive', 'Agreement reached') THEN CASE interaction_type WHEN 'SPA' THEN 15 WHEN 'Type B meeting' THEN 10 ELSE 5 END
    WHEN outcome = 'Complete Response letter' THEN -20 ELSE 0 END * ({fade(age('interaction_date', 'te'))})) AS talk FROM t JOIN d_regulator x ON x.company_id = t.company_id AND interaction_date < te AND interaction_date >= te - INTERVAL 2 YEAR GROUP BY 1, 2),
h AS (SELECT t.company_id, day, count(*) FILTER (WHERE issue_type = 'clinical_hold') AS holds, count(*) FILTER (WHERE issue_type = 'warning_letter') AS warnings
  FROM t JOIN d_issues x ON x.company_id = t.company_id AND issue_date < te AND issue_date >= te - INTERVAL 2 YEAR GROUP BY 1, 2),
rc AS (SELECT t.company_id, t.day, coalesce(r.signals, 0) AS signals, lu, {score(REGULATOR)} AS score FROM t LEFT JOIN r {ON.format('r')} LEFT JOIN h {ON.format('h')}),
b AS (SELECT * FROM d_acquirers WHERE is_active ORDER BY market_cap DESC, acquirer_id LIMIT 5),
sc AS (SELECT company_id, avg(fit) AS score, count(*) AS signals FROM (SELECT c.company_id, CASE WHEN len(c.areas) > 0 AND len(b.areas) > 0 THEN {score(FIT)} ELSE 50e0 END AS fit FROM d_companies c CROSS JOIN b) q GROUP BY 1),
l AS (SELECT 'pipeline' AS component, t.company_id, t.day, 0.3e0 AS w, coalesce(score, 0e0) AS score, coalesce(signals, 0) AS signals, CAST(NULL AS TIMESTAMP) AS lu FROM t LEFT JOIN ac {ON.format('ac')}
  UNION ALL SELECT 'patent', t.company_id, t.day, 0.2e0, coalesce(score, 0e0), coalesce(signals, 0), NULL FROM t LEFT JOIN pc {ON.format('pc')}
  UNION ALL SELECT 'financial', t.company_id, t.day, 0.15e0, coalesce(score, 0e0), 1, NULL FROM t LEFT JOIN fc {ON.format('fc')}
  UNION ALL SELECT 'insider', t.company_id, t.day, 0.15e0, coalesce(score, 50e0), coalesce(signals, 0), lu FROM t LEFT JOIN ic {ON.format('ic')}
  UNION ALL SELECT 'strategic_fit', t.company_id, t.day, 0.1e0, score, signals, NULL FROM t JOIN sc ON sc.company_id = t.company_id
  UNION ALL SELECT 'regulatory', company_id, day, 0.1e0, score, signals, lu FROM rc)"""


@query("K1", "backtest_rebuilt", f"""WITH g AS (SELECT deal_id, target_id AS company_id, o AS step, CAST({ANNOUNCED} AS DATE) - CAST(o + 1 AS INTEGER) AS day FROM d_deals, (SELECT unnest(range(1, 25)) AS o)),
t AS (SELECT company_id, day, CAST(day + 1 AS TIMESTAMP) AS te, CAST(day + 1 AS TIMESTAMP) - INTERVAL 8096 DAY AS td FROM (SELECT DISTINCT g.company_id, day FROM g JOIN d_companies c ON c.company_id = g.company_id) q),
{PARTS},
e AS (SELECT company_id, day, {score('least(100e0, greatest(0e0, sum(score * w)))')} AS overall_score, {score(CONFIDENCE)} AS confidence FROM l GROUP BY 1, 2)
SELECT deal_id, CAST(step AS BIGINT) AS step, step IN (1, 3, 6, 12) AS profile_step, CAST(g.day AS VARCHAR) AS day, overall_score, confidence FROM g JOIN e ON e.company_id = g.company_id AND e.day = g.day""")
def _rebuilt(t):
    # the data spans a month, so a step is a day here
    d = bt.rebuilt_backtest(announcements(t), step_days=1, weights=co.weights_table(t.spark), **FEEDS(t))
    return d.select("deal_id", n("step"), "profile_step", s("day"), "overall_score", "confidence")


FEEDS = lambda t: dict(companies=t.companies, assets=t.assets, patents=t.patents, financials=t.financials, transactions=t.insider, holdings=t.holdings,
                       pathways=pathways(t), interactions=t.regulator, issues=t.issues, acquirers=t.acquirers, shift_days=SHIFT_DAYS)
PICK = lambda name: f"max(score) FILTER (WHERE component = '{name}')"


@query("C23", "deep_dive_history", f"""WITH t AS (SELECT company_id, score_date AS day, CAST(score_date + 1 AS TIMESTAMP) AS te, CAST(score_date + 1 AS TIMESTAMP) - INTERVAL 8096 DAY AS td
  FROM (SELECT DISTINCT s.company_id, score_date FROM d_scores s JOIN d_companies c ON c.company_id = s.company_id WHERE score_date >= DATE '2023-11-02') q),
{PARTS},
hh AS (SELECT l.company_id, l.day, {', '.join(f"{PICK(c)} AS {c}" for c in ('pipeline', 'financial', 'strategic_fit', 'insider', 'regulatory'))} FROM l GROUP BY 1, 2),
pl AS (SELECT company_id, count(*) AS programmes, string_agg(asset_id, '|' ORDER BY phase_rank DESC, asset_id) AS programme_ids FROM d_assets GROUP BY 1),
hx AS (SELECT h.company_id, count(*) AS days, string_agg(concat_ws(':', CAST(h.day AS VARCHAR), CAST({score('s.score')} AS DECIMAL(9,2)), CAST({score('pipeline')} AS DECIMAL(9,2)), CAST({score('financial')} AS DECIMAL(9,2)), CAST({score('insider')} AS DECIMAL(9,2)), CAST({score('regulatory')} AS DECIMAL(9,2))), '|' ORDER BY h.day) AS history
  FROM hh h JOIN d_scores s ON s.company_id = h.company_id AND s.score_date = h.day GROUP BY 1)
SELECT c.company_id, programmes, programme_ids, days, history FROM d_companies c LEFT JOIN pl p ON p.company_id = c.company_id LEFT JOIN hx x ON x.company_id = c.company_id""")
def _dive_history(t):
    from dealsight.operators.profile import deep_dive

    recent = t.scores.filter("score_date >= DATE'2023-11-02'")
    found = bt.component_scores(recent.select("company_id", F.col("score_date").alias("day")), **FEEDS(t)).withColumnRenamed("day", "score_date")
    history = t.scores.join(found, ["company_id", "score_date"], "left")
    d = deep_dive(t.companies, t.latest, t.assets, t.signals, t.patents, t.financials, history, NOW[:10], components=["pipeline", "financial", "insider", "regulatory"])
    num = lambda x: tidy(x).cast("decimal(9,2)").cast("string")
    line = lambda x: F.concat_ws(":", x["score_date"].cast("string"), *[num(x[c]) for c in ("score", "pipeline", "financial", "insider", "regulatory")])
    return d.select("company_id", F.size("programmes").cast("bigint").alias("programmes"), F.array_join(F.transform("programmes", lambda x: x["asset_id"].cast("string")), "|").alias("programme_ids"),
                    F.size("component_history").cast("bigint").alias("days"), F.array_join(F.transform("component_history", line), "|").alias("history"))


@query("C23", "deep_dive_buyers", f"""WITH {PAIRS} SELECT c.company_id, count(m.acquirer_id) AS buyers, coalesce(string_agg(m.acquirer_id, '|' ORDER BY rk), '') AS buyer_ids, round(max(match_score), 2) AS best_score
FROM d_companies c LEFT JOIN x_match m ON m.company_id = c.company_id GROUP BY 1""")
def _dive_buyers(t):
    from dealsight.operators.profile import deep_dive

    d = deep_dive(t.companies, t.latest, t.assets, t.signals, t.patents, t.financials, t.scores, NOW[:10], matches=matches(t))
    buyers = F.coalesce("buyers", F.array().cast("array<struct<_rk:int,acquirer_id:bigint,match_score:double,likelihood:double>>"))
    d = d.withColumn("_b", buyers)
    return d.select("company_id", F.size("_b").cast("bigint").alias("buyers"), F.array_join(F.transform("_b", lambda x: x["acquirer_id"].cast("string")), "|").alias("buyer_ids"),
                    F.round(F.array_max(F.transform("_b", lambda x: x["match_score"])), 2).alias("best_score"))
