"""Eight-factor rule queries (E31-E42, F9) and stream-operator queries."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import DEAL_AS_OF as DEAL, EVENT_AS_OF as NOW
from dealsight.functions.bands import sql_above, sql_at_least, sql_at_most, sql_below, sql_lookup, sql_tidy
from dealsight.operators import history as hi, spec as op
from dealsight.plans.catalog import join_list, n, query, r, s
from dealsight.plans.scoring import DAYS, TS_DEAL, TS_NOW
from dealsight.streaming import alerts as al, events as st

D = lambda x: f"CAST({x} AS DOUBLE)"
RIV = "x_riv AS (SELECT indication, mechanism, count(*) - 1 AS rivals FROM d_assets GROUP BY 1, 2)"
S35 = f"""x_35a AS (SELECT a.*, rivals, endpoint_met, p_value, effect, novelty, superior FROM d_assets a JOIN x_riv v ON v.indication = a.indication AND v.mechanism = a.mechanism JOIN d_clinical c ON c.asset_id = a.asset_id),
x_35 AS (SELECT company_id, {sql_tidy(f'''0.4e0 * least(100e0, sum({sql_lookup('phase', op.PHASE_VALUE, 0)} * CASE WHEN orphan THEN 1.3e0 ELSE 1 END * CASE WHEN fast_track THEN 1.2e0 ELSE 1 END * CASE WHEN breakthrough THEN 1.4e0 ELSE 1 END * CASE WHEN priority_review THEN 1.3e0 ELSE 1 END))
  + 0.25e0 * avg(least(100, greatest(0, 100 - rivals * 5 + CASE WHEN rivals = 0 THEN 30 ELSE 0 END - CASE WHEN rivals > 10 THEN 40 ELSE 0 END)))
  + 0.2e0 * least(100, max({sql_above('peak_sales', op.MARKET_POINTS, 10)} + CASE WHEN rivals = 0 THEN 50 WHEN rivals < 3 THEN 35 WHEN rivals <= 10 THEN 25 ELSE 10 END))
  + 0.15e0 * max(CASE WHEN endpoint_met THEN 100 ELSE 20 END * 0.4e0 + {sql_below('p_value', op.P_VALUE, 10)} * 0.3e0 + CASE WHEN effect >= 1 THEN 100 WHEN effect >= 0.7e0 THEN 75 WHEN effect >= 0.3e0 THEN 50 ELSE 25 END * 0.3e0)''')} AS score FROM x_35a GROUP BY company_id)"""
LIT = "CASE family_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'defended' WHEN 2 THEN 'minor' WHEN 3 THEN 'major' ELSE 'invalidated' END"
FTO = "CASE asset_id % 5 WHEN 0 THEN 'clear' WHEN 1 THEN 'minor' WHEN 2 THEN 'licensed' WHEN 3 THEN 'blocked' ELSE 'multiple' END"
S36 = f"""x_36 AS (SELECT company_id, max({sql_tidy(f'''0.35e0 * CASE WHEN is_composition THEN 100 WHEN is_formulation AND is_method THEN 75 WHEN is_method THEN 50 ELSE 25 END
  + 0.3e0 * {sql_above('yrs', op.PATENT_LIFE, 10)} + 0.2e0 * {sql_lookup('lit', op.LITIGATION, 10)} + 0.15e0 * {sql_lookup('fto', op.FREEDOM, 10)}''')}) AS score
  FROM (SELECT *, {DAYS(TS_DEAL, 'expiry_date')} / 365.25e0 AS yrs, {LIT} AS lit, {FTO} AS fto FROM d_patents) q GROUP BY company_id)"""
KIND = "CASE deal_id % 5 WHEN 0 THEN 'phase_3' WHEN 1 THEN 'nda_filing' WHEN 2 THEN 'phase_2' WHEN 3 THEN 'partnership' ELSE 'none' END"
S37 = f"""x_37f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY as_of_date DESC) rk FROM d_financials) WHERE rk = 1),
x_37c AS (SELECT * FROM (SELECT target_id AS company_id, deal_date + INTERVAL 4 YEAR AS cd, {KIND} AS kind, row_number() OVER (PARTITION BY target_id ORDER BY deal_date, deal_id) rk FROM d_deals WHERE deal_date + INTERVAL 4 YEAR >= {TS_DEAL}) WHERE rk = 1),
x_37 AS (SELECT company_id, {sql_tidy(f'''least(100e0, {sql_below('(run / nullif(mo, 0))', op.PRESSURE, 15)} * CASE WHEN mo < 6 THEN {D(sql_lookup('kind', op.URGENCY, 1.0))} WHEN mo IS NULL THEN 0.8e0 ELSE 1 END)''')} AS score
  FROM (SELECT f.company_id, CASE WHEN burn_rate > 0 THEN cash / burn_rate ELSE 999e0 END AS run, {DAYS(TS_DEAL, 'cd')} / 30.4e0 AS mo, kind FROM x_37f f LEFT JOIN x_37c c ON c.company_id = f.company_id) q)"""
S38 = f"""x_38a AS (SELECT *, count(*) OVER (PARTITION BY company_id ORDER BY event_date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) - 1 AS related, {DAYS('event_date', TS_NOW)} AS dd FROM d_management),
x_38 AS (SELECT company_id, {sql_tidy(f"least(100e0, sum({sql_lookup('kind', op.MANAGEMENT, 0)} * {D(sql_below('dd', op.MANAGEMENT_RECENCY, 0.2))} * CASE WHEN related >= 1 THEN 1.3e0 WHEN weak THEN 0.7e0 ELSE 1 END))")} AS score FROM x_38a GROUP BY company_id)"""
SIZE = lambda x: f"CASE WHEN {x} < 0.1 THEN 30 WHEN {x} < 0.3 THEN 50 WHEN {x} < 0.5 THEN 75 WHEN {x} > 4 THEN 25 WHEN {x} > 2.5 THEN 50 WHEN {x} > 1.5 THEN 75 ELSE 100 END"
S39 = f"""x_39 AS (SELECT company_id, {sql_tidy(f'''0.3e0 * CASE WHEN coalesce(b.n, 0) >= 3 THEN 100 WHEN coalesce(b.n, 0) >= 1 THEN 75 ELSE 10 END + 0.25e0 * (20 + 20 * (nation_no % 5)) + 0.15e0 * (20 + 10 * (nation_no % 8))
  + 0.2e0 * CASE WHEN t.v IS NULL THEN 25 ELSE {SIZE('(market_cap / t.v)')} END + 0.1e0 * CASE WHEN coalesce(g.n, 0) > 0 THEN 80 ELSE 40 END''')} AS score FROM d_companies c
  LEFT JOIN (SELECT area, count(*) n FROM (SELECT unnest(areas) AS area FROM d_acquirers) GROUP BY 1) b ON b.area = lead_area
  LEFT JOIN (SELECT area, count(*) n FROM (SELECT unnest(gaps) AS area FROM d_acquirers) GROUP BY 1) g ON g.area = lead_area
  LEFT JOIN (SELECT area, avg(deal_value) v FROM d_deals WHERE deal_date >= {TS_DEAL} - INTERVAL 60 MONTH GROUP BY 1) t ON t.area = lead_area)"""
S40 = f"""x_40 AS (SELECT company_id, max({D(f'''least(100, greatest(0, 100 - ({sql_at_most('rivals', op.COMPETITOR_PENALTY, 70)} + {sql_at_most('ap', op.APPROVED_PENALTY, 50)}
  + CASE novelty WHEN 'best_in_class' THEN -20 WHEN 'first_in_class' THEN -15 WHEN 'me_too' THEN 30 ELSE 0 END + CASE WHEN superior THEN -25 ELSE 0 END)))''')}) AS score
  FROM x_35a a JOIN (SELECT indication, count(*) FILTER (WHERE phase = 'approved') AS ap FROM d_assets GROUP BY 1) p ON p.indication = a.indication GROUP BY company_id)"""
PATH = "CASE company_id % 7 WHEN 0 THEN 'clear' WHEN 1 THEN 'orphan' WHEN 2 THEN 'accelerated' WHEN 3 THEN 'standard' WHEN 4 THEN 'novel' WHEN 5 THEN 'guided' ELSE 'unclear' END"
RISKK = "CASE WHEN value > 250 THEN 'hold_current' WHEN value > 200 THEN 'letter' WHEN value > 150 THEN 'guidance' WHEN value > 120 THEN 'manufacturing' ELSE 'none' END"
S41 = f"""x_41 AS (SELECT c.company_id, {D(f"least(100, greatest(0, {sql_lookup(PATH.replace('company_id', 'c.company_id'), op.PATHWAY, 30)} - coalesce(p, 0)))")} AS score FROM d_companies c
  LEFT JOIN (SELECT company_id, sum({sql_lookup('risk', op.RISK, 0)}) AS p FROM (SELECT DISTINCT company_id, {RISKK} AS risk FROM d_signals WHERE source_type = 'error') z GROUP BY 1) r ON r.company_id = c.company_id)"""
IDX = lambda c: f"list_position(['preclinical', 'phase_1', 'phase_2', 'phase_3', 'nda_bla', 'approved'], {c})"
S42 = f"""x_42d AS (SELECT * FROM d_deals WHERE deal_date >= {TS_DEAL} - INTERVAL 36 MONTH), x_42a AS (SELECT area, count(*) n, avg(premium) pr FROM x_42d GROUP BY 1), x_42s AS (SELECT area, stage, count(*) k FROM x_42d GROUP BY 1, 2),
x_42m AS (SELECT area, stage AS mode FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY k DESC, stage DESC) rk FROM x_42s) WHERE rk = 1),
x_42 AS (SELECT c.company_id, {sql_tidy(f'''0.4e0 * {sql_at_least('coalesce(n, 0)', op.DEAL_FREQUENCY, 20)} + 0.3e0 * {sql_above('coalesce(pr, 0)', op.PREMIUM_TREND, 30)}
  + 0.3e0 * CASE WHEN lead_phase = mode THEN 100 WHEN abs({IDX('lead_phase')} - {IDX('mode')}) = 1 THEN 75 WHEN coalesce(k, 0) > 0 AND k / n >= 0.1 THEN 50 WHEN coalesce(k, 0) > 0 THEN 25 ELSE 10 END''')} AS score
  FROM d_companies c LEFT JOIN x_42a a ON a.area = lead_area LEFT JOIN x_42m m ON m.area = lead_area LEFT JOIN x_42s s ON s.area = lead_area AND s.stage = lead_phase)"""


def clinical_assets(t):
    return t.assets.join(t.clinical.select("asset_id", "endpoint_met", "p_value", "effect", "novelty", "superior"), "asset_id")


def f35(t): return op.factor_pipeline(clinical_assets(t))
def f36(t): return op.factor_patent(t.patents.withColumn("litigation", F.expr(LIT)).withColumn("freedom", F.expr(FTO)), DEAL)


def f37(t):
    from dealsight.functions.scale import latest_per_key

    cat = t.deals.select(F.col("target_id").alias("company_id"), F.col("deal_id").alias("catalyst_id"), (F.col("deal_date") + F.expr("INTERVAL 4 YEARS")).alias("catalyst_date"), F.expr(KIND).alias("kind"))
    return op.factor_runway(latest_per_key(t.financials, ["company_id"], ["as_of_date"]), cat, DEAL)


def f38(t): return op.factor_management(t.management, NOW, 2)


def f39(t):
    c = t.companies.withColumn("technology_fit", 20 + 20 * (F.col("nation_no") % 5)).withColumn("geographic_fit", 20 + 10 * (F.col("nation_no") % 8))
    return op.factor_strategic_fit(c, t.acquirers, t.deals, DEAL)


def f40(t): return op.factor_competition(clinical_assets(t))


def f41(t):
    risks = t.signals.filter("source_type = 'error'").select("company_id", F.expr(RISKK).alias("risk"))
    return op.factor_regulatory(t.companies.select("company_id", F.expr(PATH).alias("pathway")), risks)


def f42(t): return op.factor_history(t.companies, t.deals, DEAL)


for _item, _name, _ctes, _cte, _fn in [
    ("E35", "spec_factor_assets", f"{RIV}, {S35}", "x_35", f35), ("E36", "spec_factor_patent", S36, "x_36", f36), ("E37", "spec_factor_runway", S37, "x_37", f37),
    ("E38", "spec_factor_management", S38, "x_38", f38), ("E39", "spec_factor_strategic_fit", S39, "x_39", f39),
    ("E40", "spec_factor_competition", f"{RIV}, {S35}, {S40}", "x_40", f40), ("E41", "spec_factor_regulatory", S41, "x_41", f41), ("E42", "spec_factor_history", S42, "x_42", f42)]:
    query(_item, _name, f"WITH {_ctes} SELECT company_id, score FROM {_cte}")(lambda t, fn=_fn: fn(t).select("company_id", "score"))

NAMES = {"pipeline": ("x_35", f35), "patent": ("x_36", f36), "runway": ("x_37", f37), "management": ("x_38", f38), "strategic_fit": ("x_39", f39),
         "competition": ("x_40", f40), "regulatory": ("x_41", f41), "history": ("x_42", f42)}
DF = f"{D(sql_at_least('((company_id % 10) / 9e0)', op.COMPLETENESS, 0.4))} * {D(sql_below('(company_id * 7 % 400)', op.FRESHNESS, 0.4))} * CASE company_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.95e0 ELSE 0.8e0 END"


@query("E31", "spec_eight_factor_score", f"WITH {RIV}, {S35}, {S36}, {S37}, {S38}, {S39}, {S40}, {S41}, {S42}, x_u AS (" + " UNION ALL ".join(
    f"SELECT company_id, {op.FACTOR_WEIGHTS[k]}e0 AS w, score FROM {c}" for k, (c, _) in NAMES.items()) + f") SELECT company_id, {sql_tidy(f'least(100e0, greatest(0e0, sum(w * score * ({DF}))))')} AS score, count(*) AS factors FROM x_u GROUP BY 1")
def _eight(t):
    out = None
    for k, (_, fn) in NAMES.items():
        d = fn(t).select("company_id", F.lit(k).alias("factor"), F.col("score").cast("double").alias("score"))
        out = d if out is None else out.unionByName(d)
    src = F.when(F.col("company_id") % 3 == 0, "primary").when(F.col("company_id") % 3 == 1, "company").otherwise("news")
    d = op.data_factor((F.col("company_id") % 10) / 9, F.col("company_id") * 7 % 400, src)
    return op.eight_factor_score(out.withColumn("d", d)).select("company_id", "score", "factors")


DSZ = "CASE WHEN size_ratio < 0.1 THEN 20 WHEN size_ratio < 0.2 THEN 40 WHEN size_ratio < 0.3 THEN 60 WHEN size_ratio < 0.5 THEN 80 WHEN size_ratio > 6 THEN 20 WHEN size_ratio > 4 THEN 40 WHEN size_ratio > 2.5 THEN 60 WHEN size_ratio > 1.5 THEN 80 ELSE 100 END"


@query("E32", "spec_matching_score", f"""WITH c AS (SELECT *, least(100e0, CASE priority WHEN 'high' THEN 100 WHEN 'medium' THEN 52.5 WHEN 'low' THEN 20 WHEN 'adjacent' THEN 9 ELSE 0 END + CASE technology WHEN 'match' THEN 15 WHEN 'complementary' THEN 10 ELSE 0 END) AS al,
  0.6e0 * {sql_at_most('abs(months_to_cliff - months_to_approval)', [(6, 100), (12, 80), (24, 60), (36, 40)], 20)} + 0.3e0 * CASE cliff_match WHEN 'indication' THEN 100 WHEN 'area' THEN 75 WHEN 'related' THEN 50 ELSE 25 END + 0.1e0 * least(100, sales_ratio * 100) AS cf,
  {DSZ} * least(1e0, funding_ratio) AS vf, CASE stage_match WHEN 'preferred' THEN 90 WHEN 'adjacent' THEN 70 WHEN 'acceptable' THEN 50 ELSE 30 END + CASE data_state WHEN 'phase_3_positive' THEN 10 WHEN 'phase_2_strong' THEN 8 WHEN 'phase_2_early' THEN 5 ELSE 3 END AS sf,
  0.4e0 * CASE WHEN deals_in_area > 5 THEN 100 WHEN deals_in_area >= 3 THEN 80 WHEN deals_in_area >= 1 THEN 60 ELSE 20 END + 0.3e0 * CASE WHEN deals_at_stage > 3 THEN 100 WHEN deals_at_stage >= 2 THEN 75 WHEN deals_at_stage = 1 THEN 50 ELSE 25 END + 0.3e0 * {DSZ} AS hp,
  0.5e0 * CASE WHEN product_gap >= 3 THEN 100 WHEN product_gap = 2 THEN 75 WHEN product_gap = 1 THEN 50 WHEN product_gap = 0 THEN 25 ELSE 10 END + 0.3e0 * CASE WHEN revenue_growth < -10 THEN 100 WHEN revenue_growth <= 0 THEN 70 WHEN revenue_growth < 5 THEN 50 WHEN revenue_growth <= 10 THEN 30 ELSE 10 END
    + 0.2e0 * CASE threat WHEN 'launched' THEN 100 WHEN 'phase_3' THEN 80 WHEN 'erosion' THEN 70 ELSE 30 END AS ur FROM d_pair_inputs)
SELECT deal_id, {sql_tidy('al * 0.25e0 + cf * 0.25e0 + vf * 0.2e0 + sf * 0.15e0 + hp * 0.1e0 + ur * 0.05e0')} AS match_score,
  {sql_tidy(f'''least(1e0, {D(sql_at_least('target_score', op.BASE_PROBABILITY, 0.03))} * CASE WHEN strong_80 >= 2 THEN 1.5e0 WHEN strong_70 >= 2 THEN 1.3e0 WHEN strong_70 = 1 THEN 1 ELSE 0.7e0 END
   * CASE WHEN months_to_catalyst < 6 AND low_runway THEN 1.4e0 WHEN months_to_catalyst <= 12 THEN 1.2e0 WHEN months_to_catalyst <= 18 THEN 1 WHEN months_to_catalyst > 18 THEN 0.8e0 ELSE 0.6e0 END)''', 4)} AS probability FROM c""")
def _smatch(t):
    return op.spec_matching_score(t.pair_inputs).select("deal_id", "match_score", "probability")


KINDS = "CASE k % 10 WHEN 0 THEN 'ceo_departure' WHEN 1 THEN 'strategic_review' WHEN 2 THEN 'insider_buying' WHEN 3 THEN 'board_additions' WHEN 4 THEN 'cash_runway' WHEN 5 THEN 'asset_sale' WHEN 6 THEN 'phase_3_start' WHEN 7 THEN 'partnership_talks' WHEN 8 THEN 'clinical_hold' ELSE 'regulatory_guidance' END"
FAM = "CASE k % 6 WHEN 0 THEN 'clinical' WHEN 1 THEN 'management' WHEN 2 THEN 'financial' WHEN 3 THEN 'market' WHEN 4 THEN 'regulatory' ELSE 'insider' END"
VER = "CASE k % 4 WHEN 0 THEN 'multiple' WHEN 1 THEN 'verified' WHEN 2 THEN 'single' ELSE 'rumor' END"
COMB = f"""x_s AS (SELECT *, {KINDS} AS kind, exp(-{D(sql_lookup(f'({FAM})', op.DECAY, 0.01))} * {DAYS('event_date', TS_NOW)}) AS w, {D(sql_lookup(f'({VER})', op.VERIFIED, 0.6))} AS ver FROM d_signals),
x_cb AS (SELECT company_id, kind, coalesce(sum(value * w * confidence) / nullif(sum(w * confidence), 0), 0) AS combined, avg(confidence * w * ver) AS cn FROM x_s GROUP BY 1, 2)"""


def combined(t):
    sig = t.signals.withColumn("kind", F.expr(KINDS)).withColumn("family", F.expr(FAM)).withColumn("verification", F.expr(VER))
    return op.signal_combination(sig, NOW)


@query("E33", "spec_signal_combination", f"WITH {COMB} SELECT company_id, kind, round(combined, 6) AS combined, round(cn, 6) AS confidence_now FROM x_cb")
def _comb(t):
    return combined(t).select("company_id", "kind", r("combined"), r("confidence_now"))


@query("E33", "spec_correlation_discount", f"WITH {COMB}, p(partner, kind, r) AS (VALUES " + ", ".join(f"('{a}', '{b}', {x}e0)" for a, b, x in op.CORRELATED) + """)
SELECT c.company_id, round(sum(c.combined * CASE WHEN o.kind IS NOT NULL THEN 1 - p.r ELSE 1 END), 6) AS adjusted, round(sum(c.combined), 6) AS plain, count(o.kind) AS discounts
FROM x_cb c LEFT JOIN p ON p.kind = c.kind LEFT JOIN x_cb o ON o.company_id = c.company_id AND o.kind = p.partner GROUP BY 1""")
def _disc(t):
    return op.correlation_discount(combined(t)).select("company_id", r("adjusted"), r("plain"), n("discounts"))


@query("E34", "signal_extraction", """SELECT 'filing' AS kind, doc_id AS id, signal, strength FROM documents, (VALUES (2, 'partnership_announced', 1.0e0), (3, 'acquisition_active', -0.5e0), (5, 'leadership_turnover', 0.6e0)) m(k, signal, strength) WHERE doc_id % k = 0
UNION ALL SELECT 'trial', event_id, signal, strength FROM (SELECT event_id, unnest(list_filter([CASE WHEN p = 'Phase 1' AND phase = 'Phase 2' THEN {'signal': 'clinical_progression', 'strength': 0.3e0} WHEN p = 'Phase 2' AND phase = 'Phase 3' THEN {'signal': 'clinical_progression', 'strength': 0.7e0}
  WHEN p = 'Phase 3' AND phase = 'Completed' THEN {'signal': 'clinical_progression', 'strength': 0.5e0} END, CASE WHEN event_type = 'error' THEN {'signal': 'clinical_failure', 'strength': 0.8e0} END], lambda x: x IS NOT NULL), recursive := true)
  FROM (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'Phase 1' WHEN 'view' THEN 'Phase 2' WHEN 'click' THEN 'Phase 3' ELSE 'Completed' END AS phase FROM events)) z) y""")
def _extract(t):
    items = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "1.01"), F.when(F.col("doc_id") % 3 == 0, "2.01"), F.when(F.col("doc_id") % 5 == 0, "5.02")), lambda x: x.isNotNull())
    a = op.filing_signals(t.documents.select("doc_id", items.alias("items"))).select(F.lit("filing").alias("kind"), F.col("doc_id").alias("id"), "signal", "strength")
    ph = F.expr("CASE event_type WHEN 'signup' THEN 'Phase 1' WHEN 'view' THEN 'Phase 2' WHEN 'click' THEN 'Phase 3' ELSE 'Completed' END")
    u = t.events.select("event_id", "ts", F.col("user_id").alias("trial_id"), ph.alias("phase"), F.when(F.col("event_type") == "error", "Terminated").otherwise("Active").alias("status"))
    return a.unionByName(op.trial_signals(u).select(F.lit("trial").alias("kind"), F.col("event_id").alias("id"), "signal", "strength"))


MOM = lambda x: f"CASE WHEN {x} > 0.5 THEN 'Accelerating' WHEN {x} > 0.2 THEN 'Increasing' WHEN {x} >= -0.2 THEN 'Stable' WHEN {x} >= -0.5 THEN 'Decreasing' ELSE 'Decelerating' END"


@query("F9", "signal_momentum", f"""WITH g AS (SELECT company_id, count(*) FILTER (WHERE event_date >= {TS_NOW} - INTERVAL 5 DAY) AS recent, count(*) AS al FROM d_signals WHERE event_date >= {TS_NOW} - INTERVAL 25 DAY GROUP BY 1), m AS (SELECT *, round(recent / (al * 5 / 25e0) - 1, 9) AS mo FROM g)
SELECT company_id, recent, round(mo, 6) AS momentum, {MOM('mo')} AS category, CASE {MOM('mo')} WHEN 'Accelerating' THEN 5 WHEN 'Increasing' THEN 2 WHEN 'Stable' THEN 0 WHEN 'Decreasing' THEN -2 ELSE -5 END AS points FROM m""")
def _mom(t):
    return op.signal_momentum(t.signals, NOW, 5, 25).select("company_id", n("recent"), r("momentum"), "category", "points")


# ---- stream operators ----------------------------------------------------------
ETYPE = "CASE event_type WHEN 'view' THEN 'clinical_trial_signal' WHEN 'click' THEN 'patent_cliff' WHEN 'purchase' THEN 'insider_activity' WHEN 'signup' THEN 'hiring_signal' ELSE 'price_tick' END"


def envelopes(t):
    """JSON envelopes carrying each event."""
    payload = F.to_json(F.struct(F.col("user_id").alias("company_id"), F.col("value").alias("signal_strength"), F.lit("high").alias("severity"),
                                 F.col("event_id").alias("shares"), F.col("event_id").alias("job_count")))
    env = F.struct(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("feed").alias("source"),
                   F.expr(ETYPE).alias("event_type"), payload.alias("payload"), F.lit("1.0").alias("version"), F.col("user_id").cast("string").alias("correlation_id"))
    return t.events.select(F.to_json(env).alias("value"))


@query("I1", "event_envelope_stream", f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {ETYPE} AS event_type, CASE WHEN event_type = 'view' THEN round(value, 6) END AS strength, CASE WHEN event_type = 'purchase' THEN event_id END AS shares,
  event_type <> 'error' AS is_known, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM events""")
def _env(t):
    d = st.parse_envelopes(envelopes(t))
    return d.select("event_id", "event_type", r(F.col("clinical_trial_signal.signal_strength")).alias("strength"), F.col("insider_activity.shares").alias("shares"), "is_known",
                    F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("timestamp")).alias("ts_us"))


ROUTES = {"aggregator": "signals.*", "scorer": "signals.patent", "audit": "#", "analyst": "analysis.#"}


@query("I2", "topic_routing", """SELECT h AS handler, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_type <> 'error' THEN 'aggregator' END, CASE WHEN event_type = 'click' THEN 'scorer' END, 'audit', CASE WHEN event_type = 'error' THEN 'analyst' END], lambda x: x IS NOT NULL)) AS h FROM events) x GROUP BY 1""")
def _route(t):
    topic = F.expr("CASE event_type WHEN 'view' THEN 'signals.trial' WHEN 'click' THEN 'signals.patent' WHEN 'purchase' THEN 'signals.insider' WHEN 'signup' THEN 'signals.hiring' ELSE 'analysis.error.raised' END")
    return st.topic_routing(t.events.withColumn("topic", topic), ROUTES).groupBy("handler").agg(F.count(F.lit(1)).alias("n"))


@query("I3", "signal_window", """SELECT company_id, CAST(epoch(h - INTERVAL 1 HOUR * i) AS BIGINT) AS start_s, count(*) AS signals FROM (SELECT company_id, date_trunc('hour', event_date) AS h FROM d_signals), (SELECT unnest(range(24)) AS i) GROUP BY 1, 2""")
def _window(t):
    return st.signal_window_batch(t.signals).select("company_id", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("start")).alias("start_s"), "signals")


@query("I4", "rescore_trigger", """WITH RECURSIVE p AS (SELECT company_id, signal_id, event_date AS ts, row_number() OVER (PARTITION BY company_id ORDER BY event_date, signal_id) AS pos FROM d_signals),
j AS (SELECT a.company_id, a.pos, greatest(a.pos + 3, 1 + (SELECT count(*) FROM p b WHERE b.company_id = a.company_id AND b.ts < a.ts + INTERVAL 24 HOUR)) AS nx FROM p a),
r AS (SELECT company_id, pos FROM p WHERE pos = 3 UNION ALL SELECT p.company_id, p.pos FROM r JOIN j ON j.company_id = r.company_id AND j.pos = r.pos JOIN p ON p.company_id = j.company_id AND p.pos = j.nx)
SELECT r.company_id, signal_id, r.pos AS position FROM r JOIN p ON p.company_id = r.company_id AND p.pos = r.pos""")
def _trigger(t):
    return st.rescore_triggers(t.signals, "company_id", "event_date", "signal_id", 3, 24).select("company_id", "signal_id", n("position"))


SCEV = """x_se AS (SELECT company_id, score_date, score, lag(score) OVER (PARTITION BY company_id ORDER BY score_date) AS prev FROM d_scores)"""


def score_events(t):
    d = hi.change_over(t.scores, [])  # history rows as score events
    from pyspark.sql import Window as W

    d = d.withColumn("previous_score", F.lag("score").over(W.partitionBy("company_id").orderBy("score_date")))
    return (d.withColumn("score_change", F.col("score") - F.col("previous_score")).withColumn("tier", F.when(F.col("score") >= 80, "tier_1").when(F.col("score") >= 60, "tier_2").otherwise("tier_3"))
            .withColumn("ts", F.col("score_date").cast("timestamp_ntz")))


@query("I5", "score_alerts", f"""WITH {SCEV} SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, 'tier_1_candidate' AS alert, 'high' AS severity FROM x_se WHERE score >= 80
UNION ALL SELECT company_id, CAST(score_date AS VARCHAR), 'score_change', 'medium' FROM x_se WHERE coalesce(score - prev, 0) <> 0 AND abs(score - prev) >= 15
UNION ALL SELECT company_id, CAST(score_date AS VARCHAR), 'new_candidate', 'high' FROM x_se WHERE score >= 80 AND (coalesce(prev, 0) = 0 OR prev < 60)""")
def _salerts(t):
    return al.score_alerts(score_events(t)).select("company_id", s("score_date"), "alert", "severity")


@query("I6", "watchlist_state", """WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score_date) rn FROM d_scores),
w AS (SELECT company_id, score_date, rn, score >= 70 AS member, CASE WHEN score >= 70 THEN 'added' END AS action, CASE WHEN score >= 70 THEN score END AS add_score, CASE WHEN score >= 70 THEN score END AS peak FROM m WHERE rn = 1
 UNION ALL SELECT m.company_id, m.score_date, m.rn, CASE WHEN w.member THEN m.score >= 50 ELSE m.score >= 70 END, CASE WHEN w.member THEN CASE WHEN m.score < 50 THEN 'removed' ELSE 'updated' END WHEN m.score >= 70 THEN 'added' END,
  CASE WHEN w.member AND m.score >= 50 THEN w.add_score WHEN NOT w.member AND m.score >= 70 THEN m.score END, CASE WHEN w.member AND m.score >= 50 THEN greatest(w.peak, m.score) WHEN NOT w.member AND m.score >= 70 THEN m.score END
 FROM w JOIN m ON m.company_id = w.company_id AND m.rn = w.rn + 1)
SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, member, action, round(add_score, 6) AS add_score, round(peak, 6) AS peak_score FROM w""")
def _wstate(t):
    return st.watchlist_state(t.scores).select("company_id", s("score_date"), "member", "action", r("add_score"), r("peak_score"))


@query("I7", "watchlist_alerts", """SELECT s.company_id, CAST(s.score_date AS VARCHAR) AS score_date, round(s.score - ma_score, 6) AS change FROM d_scores s JOIN d_latest l ON l.company_id = s.company_id WHERE ma_score < 60 AND ma_score >= 30 AND abs(s.score - ma_score) >= 10""")
def _walerts(t):
    w = t.latest.filter("ma_score >= 30").select("company_id", F.col("ma_score").alias("current_score"), (F.col("ma_score") < 60).alias("alerts_enabled"), F.lit(10.0).alias("alert_threshold"))
    return al.watchlist_alerts(t.scores, w).select("company_id", s("score_date"), r("change"))


@query("I8", "profile_trigger", "SELECT company_id, CAST(score_date AS VARCHAR) AS day, 'candidate_profile' AS report_type FROM d_scores WHERE score >= 80")
def _profile(t):
    return al.profile_trigger(score_events(t)).select("company_id", F.col("ts").cast("date").cast("string").alias("day"), "report_type")


ERRT = "CASE k % 6 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'RateLimitError' ELSE NULL END"


def messages(t):
    ok = F.to_json(F.struct(F.col("signal_id").cast("string").alias("event_id"), F.lit("feed").alias("source")))
    return t.signals.select("signal_id", F.when(F.col("k") % 11 == 0, "{broken").otherwise(ok).alias("body"), F.expr(ERRT).alias("error_type"), (F.col("k") % 8).alias("attempts"), F.col("event_date").alias("first_failure"))


@query("I9", "dead_letter", f"""WITH m AS (SELECT *, {ERRT} AS e, CASE WHEN k % 11 = 0 THEN 'rejected' WHEN {ERRT} IS NULL THEN 'processed' WHEN k % 8 >= 5 THEN 'dead_letter' ELSE 'retry' END AS outcome FROM d_signals)
SELECT signal_id, outcome, outcome = 'dead_letter' AND e IN ('TimeoutError', 'RateLimitError') AND event_date > {TS_NOW} - INTERVAL 24 HOUR AS replayed FROM m""")
def _dead(t):
    d = st.dead_letters(messages(t))
    again = st.replayable(d, NOW).select("signal_id", F.lit(True).alias("_r"))
    return d.join(again, "signal_id", "left").select("signal_id", "outcome", F.coalesce("_r", F.lit(False)).alias("replayed"))


@query("I10", "idempotent_events", """WITH RECURSIVE e AS (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 HOUR * CAST(event_id % 48 AS INTEGER) FROM events),
k AS (SELECT event_id, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT k.event_id, e.ts FROM k JOIN e ON e.event_id = k.event_id AND e.ts >= k.ts + INTERVAL 24 HOUR) SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM k""")
def _idem(t):
    from dealsight.operators.events import first_per_ttl

    e = t.events.select("event_id", "ts", F.lit(0).alias("copy"))
    twice = e.unionByName(e.select("event_id", (F.col("ts") + F.expr("make_dt_interval(0, CAST(event_id % 48 AS INT))")).alias("ts"), F.lit(1).alias("copy")))
    return first_per_ttl(twice, ["event_id"], "ts", "copy", 1).select("event_id", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("ts_us"))


@query("I11", "late_and_out_of_order", """WITH a AS (SELECT company_id, signal_id, event_date AS ts, event_date + INTERVAL 1 HOUR * CAST(k % 40 AS INTEGER) AS arrival FROM d_signals),
w AS (SELECT *, max(signal_id) OVER x AS ms, max(ts) OVER x AS mt FROM a WINDOW x AS (PARTITION BY company_id ORDER BY arrival, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT signal_id, coalesce(signal_id < ms, false) AS out_of_order, coalesce(ts < mt - INTERVAL 1 HOUR, false) AS late FROM w""")
def _late(t):
    a = t.signals.select("company_id", F.col("signal_id").alias("seq"), F.col("event_date").alias("ts"), (F.col("event_date") + F.expr("make_dt_interval(0, k % 40)")).alias("arrival"))
    return st.late_and_out_of_order(a).select(F.col("seq").alias("signal_id"), "out_of_order", "late")


@query("I12", "alert_dedup", """WITH RECURSIVE o AS (SELECT signal_id, company_id, signal_type, event_date AS ts FROM d_signals WHERE severity IN ('high', 'critical')),
k AS (SELECT company_id, signal_type, min(ts) AS ts FROM o GROUP BY 1, 2 UNION ALL
  SELECT k.company_id, k.signal_type, (SELECT min(o.ts) FROM o WHERE o.company_id = k.company_id AND o.signal_type = k.signal_type AND o.ts >= k.ts + INTERVAL 24 HOUR) FROM k WHERE k.ts IS NOT NULL),
f AS (SELECT min(signal_id) AS signal_id FROM o JOIN k ON k.company_id = o.company_id AND k.signal_type = o.signal_type AND k.ts = o.ts GROUP BY o.company_id, o.signal_type, o.ts)
SELECT company_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, coalesce(string_agg(DISTINCT signal_type, '|' ORDER BY signal_type) FILTER (WHERE f.signal_id IS NOT NULL), '') AS alerts,
  count(*) FILTER (WHERE f.signal_id IS NULL) AS suppressed FROM o LEFT JOIN f ON f.signal_id = o.signal_id GROUP BY 1, 2""")
def _adedup(t):
    a = t.signals.filter(F.col("severity").isin("high", "critical")).select("company_id", F.col("signal_type").alias("alert"), F.col("event_date").alias("ts"), F.col("signal_id").alias("alert_id"))
    return st.alert_dedup(a).select("company_id", s("day"), join_list("alerts"), n("suppressed"))


CHG = lambda k: f"score - last_value(score) OVER (PARTITION BY company_id ORDER BY datediff('day', DATE '2024-01-01', score_date) RANGE BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING)"


@query("I13", "spec_alert_levels", f"""WITH c AS (SELECT company_id, score_date, score AS sc, n_signals, coalesce({CHG(7)}, 0) AS c7, coalesce({CHG(14)}, 0) AS c14, coalesce({CHG(21)}, 0) AS c30 FROM d_scores),
k AS (SELECT company_id FROM d_signals WHERE source_type = 'purchase' AND event_date >= {TS_NOW} - INTERVAL 20 DAY GROUP BY 1 HAVING count(DISTINCT k % 5) >= 3)
SELECT company_id, CAST(score_date AS VARCHAR) AS score_date, company_id IN (SELECT company_id FROM k) AS insider_cluster, CASE WHEN c7 >= 15 OR sc >= 85 OR (greatest(c7, c14, c30) >= 10 AND sc >= 75) THEN 'CRITICAL'
  WHEN greatest(c7, c14) >= 10 OR sc >= 75 OR (greatest(c7, c14, c30) >= 8 AND n_signals > 1) THEN 'HIGH' WHEN greatest(c7, c14, c30) >= 5 OR sc >= 65 THEN 'MEDIUM' WHEN greatest(c7, c14, c30) >= 3 OR sc >= 55 THEN 'LOW' ELSE 'NONE' END AS level FROM c""")
def _levels(t):
    d = hi.change_over(t.scores, [7, 14, 21]).withColumnRenamed("change_21d", "change_30d").withColumn("positive_signals", F.col("n_signals")).withColumn("best_match", F.lit(0.0))
    buys = t.insider.join(t.signals.select("signal_id", (F.col("k") % 5).alias("actor")), "signal_id").select("company_id", F.col("transaction_date").alias("ts"), "actor")
    hot = st.insider_cluster(buys, NOW, 20, 3).select("company_id", F.lit(True).alias("_h"))
    return st.alert_levels(d).join(hot, "company_id", "left").select("company_id", s("score_date"), F.coalesce("_h", F.lit(False)).alias("insider_cluster"), "level")


@query("I14", "signal_activity_sessions", """WITH g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) z)
SELECT user_id, CAST(no AS BIGINT) AS session_no, count(*) AS events, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) AS end_us FROM g GROUP BY 1, 2""")
def _sessions(t):
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    d = st.activity_sessions(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", "INTERVAL 12 HOURS")
    return d.select("user_id", n("session_no"), "events", us("start").alias("start_us"), us("end").alias("end_us"))


@query("I15", "adaptive_rate_stats", "WITH g AS (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS events FROM events GROUP BY 1) SELECT user_id, events, CASE WHEN events > 100 THEN 'high' WHEN events < 10 THEN 'low' ELSE 'normal' END AS band FROM g")
def _rates(t):
    return st.source_rates(t.events, NOW, "user_id", "ts", 24).select("user_id", n("events"), "band")


@query("I16", "source_metrics", """SELECT event_type AS source, count(*) AS events, count(*) FILTER (WHERE value > 200) AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99,
  round(avg(1 - CAST(regexp_extract(props, '[0-9]+', 0) AS INT) / 200e0), 6) AS quality FROM events GROUP BY 1""")
def _metrics(t):
    e = t.events.select(F.col("event_type").alias("source"), "event_id", F.col("value").alias("latency_ms"), (F.col("value") > 200).alias("is_error"),
                        (1 - F.regexp_extract("props", "[0-9]+", 0).cast("int") / 200).alias("quality"))
    return st.source_metrics(e).select("source", n("events"), n("errors"), r("p50"), r("p90"), r("p99"), r("quality"))


@query("I17", "spec_watchlist_tiers", f"""WITH q AS (SELECT c.company_id, ma_score * 1.5e0 AS sc, CASE WHEN quarterly_burn > 0 THEN cash / (quarterly_burn / 3) ELSE 999e0 END AS run, lead_rank, market_cap, 0.5e0 + (c.company_id % 6) / 10e0 AS cf, nation_no % 6 = 0 AS sr, nation_no % 5 = 0 AS ac, nation_no % 11 = 0 AS ad,
  lead_rank = 3 AS p3, c.company_id % 5 AS sm, c.company_id % 4 AS m80 FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id),
z AS (SELECT *, (sc >= 55 AND run < 12 AND p3) OR (sc >= 50 AND sr) OR (sc >= 55 AND ac) OR (sc >= 50 AND sm >= 3) OR ad AS sp FROM q)
SELECT company_id, sp OR (sc >= 60 AND lead_rank >= 2 AND market_cap BETWEEN 1e8 AND 1e10 AND cf >= 0.7e0) AS entry, sp AS special, CASE WHEN (sc >= 80 AND cf >= 0.7e0) OR (sc >= 70 AND sr) OR (sc >= 65 AND ad) THEN 1
  WHEN (sc >= 70 AND cf >= 0.7e0) OR (sc >= 60 AND cf >= 0.7e0 AND run < 9) OR (sc >= 60 AND cf >= 0.7e0 AND m80 >= 2) THEN 2 WHEN (sc >= 60 AND cf >= 0.7e0) OR (sc >= 55 AND sp) THEN 3 WHEN (sc >= 50 AND sp) OR (sc >= 60 AND cf < 0.7e0) THEN 4 END AS tier FROM z""")
def _tiers(t):
    c = t.companies.join(t.latest, "company_id")
    run = F.when(F.col("quarterly_burn") > 0, F.col("cash") / (F.col("quarterly_burn") / 3)).otherwise(999.0)
    d = c.select("company_id", (F.col("ma_score") * 1.5).alias("score"), run.alias("runway_months"), "lead_rank", "market_cap", (F.lit(0.5) + (F.col("company_id") % 6) / 10).alias("confidence"),
                 (F.col("nation_no") % 6 == 0).alias("strategic_review"), (F.col("nation_no") % 5 == 0).alias("activist"), (F.col("nation_no") % 11 == 0).alias("advisor_hired"),
                 (F.col("lead_rank") == 3).alias("phase3_soon"), (F.col("company_id") % 5).alias("strong_matches"), (F.col("company_id") % 4).alias("matches_80"))
    return st.watchlist_tiers(d).select("company_id", "entry", "special", "tier")
