"""Comparables, momentum, market signal, sentiment and detector queries."""
import datetime

from pyspark.sql import functions as F

from dealsight.adapters.tpch import DEAL_AS_OF as DEAL, EVENT_AS_OF as NOW
from dealsight.functions.bands import sql_above, sql_at_least, sql_lookup, sql_tidy
from dealsight.operators import market as op
from dealsight.plans.catalog import n, query, r, s
from dealsight.plans.deals import Q
from dealsight.plans.scoring import DAYS, TS_DEAL, TS_NOW


@query("D6", "comparable_deals", f"SELECT deal_id, area, stage, round(deal_value, 2) AS deal_value FROM d_deals WHERE deal_date >= {TS_DEAL} - INTERVAL 36 MONTH AND area = 'oncology' AND stage = 'phase_3' AND deal_value BETWEEN 5e8 AND 4e9")
def _comparables(t):
    return op.comparable_deals(t.deals, DEAL, "oncology", "phase_3", 5e8, 4e9).select("deal_id", "area", "stage", r("deal_value", 2))


GRAIN = lambda p, ks: f"x_{p} AS (SELECT {', '.join(ks)}, count(*) n, min(mult) lo, quantile_cont(mult, 0.5) md, max(mult) hi FROM (SELECT *, deal_value / target_market_cap AS mult FROM d_deals WHERE deal_date >= {TS_DEAL} - INTERVAL 1 MONTH * 6) q GROUP BY {', '.join(ks)})"


@query("D7", "implied_valuation", f"""WITH {GRAIN('b', ['area', 'stage'])}, {GRAIN('a', ['area'])}, {GRAIN('s', ['stage'])},
j AS (SELECT c.asset_id, peak_sales, coalesce(b.n, 0) bn, coalesce(a.n, 0) an, coalesce(s.n, 0) sn, b.lo blo, b.md bmd, b.hi bhi, a.lo alo, a.md amd, a.hi ahi, s.lo slo, s.md smd, s.hi shi
  FROM d_assets c LEFT JOIN x_b b ON b.area = c.area AND b.stage = c.phase LEFT JOIN x_a a ON a.area = c.area LEFT JOIN x_s s ON s.stage = c.phase),
k AS (SELECT *, CASE WHEN bn >= 3 THEN bn WHEN an >= 3 THEN an ELSE sn END AS n FROM j)
SELECT asset_id, n, round(peak_sales * CASE WHEN bn >= 3 THEN blo WHEN an >= 3 THEN alo ELSE slo END, 2) AS low, round(peak_sales * CASE WHEN bn >= 3 THEN bmd WHEN an >= 3 THEN amd ELSE smd END, 2) AS median,
  round(peak_sales * CASE WHEN bn >= 3 THEN bhi WHEN an >= 3 THEN ahi ELSE shi END, 2) AS high, CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence, 'ev_peak_sales_multiple' AS methodology FROM k""".replace("INTERVAL 1 MONTH * 6", "INTERVAL 12 MONTH"))
def _implied(t):
    req = t.assets.select("asset_id", "area", F.col("phase").alias("stage"), "peak_sales")
    return op.implied_valuation(req, t.deals, DEAL, 1).select("asset_id", n("n"), r("low", 2), r("median", 2), r("high", 2), "confidence", "methodology")


EXQ = lambda i: f"CASE WHEN n = 1 THEN v[1] ELSE v[least(greatest({i} * (n + 1) // 4, 1), n - 1)] + ({i} * (n + 1) / 4 - least(greatest({i} * (n + 1) // 4, 1), n - 1)) * (v[least(greatest({i} * (n + 1) // 4, 1), n - 1) + 1] - v[least(greatest({i} * (n + 1) // 4, 1), n - 1)]) END"


@query("D8", "premium_quantiles", f"""SELECT area, n, round(median, 6) AS median, round(v[1], 6) AS min, round(v[n], 6) AS max, round({EXQ(1)}, 6) AS p25, round({EXQ(3)}, 6) AS p75
FROM (SELECT area, list(premium ORDER BY premium) AS v, count(*) AS n, median(premium) AS median FROM d_deals WHERE premium <> 0 GROUP BY area) x""")
def _premium_q(t):
    return op.premium_quantiles(t.deals).select("area", n("n"), r("median"), r("min"), r("max"), r("p25"), r("p75"))


@query("D9", "deal_structure_mix", "SELECT structure, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct FROM d_deals GROUP BY 1")
def _mix(t):
    return op.structure_mix(t.deals).select("structure", "n", r("pct"))


@query("D10", "avg_upfront_ratio", "SELECT stage, round(avg(CASE WHEN deal_value = 0 THEN 0 ELSE upfront / deal_value * 100 END), 6) AS upfront_ratio FROM d_deals GROUP BY 1")
def _upfront(t):
    return op.upfront_ratio(t.deals, ["stage"]).select("stage", r("upfront_ratio"))


@query("D11", "hot_areas", f"SELECT area, count(*) AS n, round(sum(deal_value), 0) AS total_value FROM d_deals WHERE deal_date >= {TS_DEAL} - INTERVAL 12 MONTH GROUP BY 1")
def _hot_areas(t):
    return op.hot_areas(t.deals, DEAL).select("area", "n", r("total_value", 0))


WORDS = {"oncology": "license", "immunology": "the the", "neurology": "password", "rare_disease": "eaux la", "cardiovascular": "copyright", "metabolic": "api"}
X_AREAS = "x_areas AS (SELECT DISTINCT area FROM d_assets)"
CUT = lambda m: f"{TS_DEAL} - INTERVAL {30 * m} DAY"
D12 = f"""x_d12 AS (SELECT a.area, CASE WHEN nn IS NULL THEN 20e0 ELSE {sql_tidy(f"least(100e0, 0.4e0 * {sql_at_least('nn', op.DEAL_COUNT, 40)} + 0.4e0 * {sql_at_least('(vv / 1000)', op.DEAL_VALUE, 40)} + {sql_above('(rr / nn)', [(0.6, 15), (0.4, 8)], 0)} + least(20, mm * 10))")} END AS deal_score
  FROM x_areas a LEFT JOIN (SELECT area, count(*) nn, sum(deal_value / 1e6) vv, count(*) FILTER (WHERE deal_date >= {TS_DEAL} - INTERVAL 180 DAY) rr, count(*) FILTER (WHERE deal_value > 5e9) mm FROM d_deals WHERE deal_date >= {CUT(5)} GROUP BY 1) g ON g.area = a.area)"""
D13 = f"""x_d13 AS (SELECT a.area, CASE WHEN nn IS NULL THEN 20e0 ELSE {sql_tidy(f"least(100e0, 0.5e0 * {sql_at_least('(vv / 1000)', op.ROUND_VALUE, 40)} + 0.3e0 * {sql_at_least('nn', op.ROUND_COUNT, 40)} + least(20, ll * 8) + CASE WHEN rr / nn > 0.5 THEN 10 ELSE 0 END)")} END AS round_score
  FROM x_areas a LEFT JOIN (SELECT area2 AS area, count(*) nn, sum(deal_value / 1e8) vv, count(*) FILTER (WHERE deal_date >= {TS_DEAL} - INTERVAL 180 DAY) rr, count(*) FILTER (WHERE deal_value / 1e8 > 100) ll FROM d_deals WHERE deal_date >= {CUT(5)} GROUP BY 1) g ON g.area = a.area)"""
D14 = f"""x_d14 AS (SELECT a.area, CASE WHEN nn IS NULL THEN 20e0 ELSE {sql_tidy(f"least(100e0, 0.6e0 * {sql_at_least('nn', op.TRIAL_COUNT, 40)} + least(20, late * 2) + 0.5e0 * least(15e0, ss * 1.5e0) + 0.5e0 * least(15, big * 3))")} END AS trial_score
  FROM x_areas a LEFT JOIN (SELECT area, count(*) nn, count(*) FILTER (WHERE phase IN ('Phase 2', 'Phase 3')) late, count(DISTINCT sponsor) ss, count(*) FILTER (WHERE enrollment > 500) big FROM d_trials WHERE start_date >= {TS_DEAL} - INTERVAL 30 DAY GROUP BY 1) g ON g.area = a.area)"""
D15 = "x_ment AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS area, CAST(sum((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}) AS BIGINT) AS mentions FROM documents" for a, w in WORDS.items()) + \
    f"), x_d15 AS (SELECT a.area, CAST({sql_at_least('coalesce(mentions, 0)', op.MENTION_COUNT, 25)} AS DOUBLE) AS mention_score FROM x_areas a LEFT JOIN x_ment m ON m.area = a.area)"


def areas(t):
    return t.assets.select("area").distinct()


def deals_mm(t):
    return t.deals.withColumn("deal_value_mm", F.col("deal_value") / 1e6)


def rounds(t):
    return t.deals.select(F.col("area2").alias("area"), F.col("deal_date").alias("invested_on"), (F.col("deal_value") / 1e8).alias("amount"))


@query("D12", "ma_volume_score", f"WITH {X_AREAS}, {D12} SELECT * FROM x_d12")
def _d12(t):
    return op.deal_volume_score(areas(t), deals_mm(t), DEAL, 5)


@query("D13", "vc_score", f"WITH {X_AREAS}, {D13} SELECT * FROM x_d13")
def _d13(t):
    return op.round_score(areas(t), rounds(t), DEAL, 5)


@query("D14", "trial_activity_score", f"WITH {X_AREAS}, {D14} SELECT * FROM x_d14")
def _d14(t):
    return op.trial_score(areas(t), t.trials, DEAL, 1)


@query("D15", "mention_score", f"WITH {X_AREAS}, {D15} SELECT d.area, mention_score, mentions FROM x_d15 d LEFT JOIN x_ment m ON m.area = d.area")
def _d15(t):
    m = op.keyword_mentions(t.documents, WORDS)
    return op.mention_score(areas(t), m).join(m, "area", "left").select("area", "mention_score", n("mentions"))


@query("D16", "momentum_score", f"""WITH {X_AREAS}, {D12}, {D13}, {D15}, {D14.replace('INTERVAL 30 DAY', 'INTERVAL 150 DAY')}, j AS (SELECT a.area, {sql_tidy('deal_score * 0.35e0 + round_score * 0.25e0 + trial_score * 0.2e0 + mention_score * 0.2e0')} AS momentum
  FROM x_d12 a JOIN x_d13 b ON b.area = a.area JOIN x_d14 c ON c.area = a.area JOIN x_d15 d ON d.area = a.area)
SELECT area, momentum, {sql_at_least('momentum', Q(op.MOMENTUM_LEVEL), "'cold'")} AS level FROM j""")
def _d16(t):
    return op.momentum_score(areas(t), DEAL, deals_mm(t), rounds(t), t.trials, op.keyword_mentions(t.documents, WORDS), 5).select("area", "momentum", "level")


@query("D17", "hot_sectors", f"WITH {X_AREAS} SELECT area, CAST({sql_lookup('area', op.AREA_BASELINE, 50)} AS DOUBLE) AS score FROM x_areas WHERE {sql_lookup('area', op.AREA_BASELINE, 50)} >= 60")
def _d17(t):
    return op.hot_sectors(areas(t), 60)


@query("D36", "trial_success_rate", "SELECT sponsor, area, count(*) FILTER (WHERE status = 'completed') AS completed, round(count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status <> 'recruiting'), 6) AS success_rate FROM d_trials GROUP BY ROLLUP (sponsor, area)")
def _success(t):
    from dealsight.operators.reports import trial_success_rate

    return trial_success_rate(t.trials, ["sponsor", "area"]).select("sponsor", "area", n("completed"), r("success_rate"))


MKT = f"""x_mk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, signal_id DESC) rk FROM d_market) WHERE rk = 1),
x_ms AS (SELECT *, round(least(100e0, greatest(0e0, 50 + {sql_at_least('volume_anomaly', [(3, 20), (2, 15), (1.5, 10)], 0)} + CASE WHEN options_activity = 'heavy_call_buying' THEN 15 ELSE 0 END
  + {sql_at_least('call_put', [(2, 5), (1.5, 3)], 0)} + least(15, accumulation * 2) + least(10e0, insider * 1.5e0) + least(10, 3 * (upgrades - downgrades)) + least(5e0, target_change / 5)
  + CASE WHEN short_change <= -20 THEN 10 WHEN short_change <= -10 THEN 5 ELSE 0 END + CASE WHEN momentum_20d >= 20 THEN 5 ELSE 0 END + CASE WHEN momentum_60d >= 30 THEN 5 ELSE 0 END)), 9) AS composite FROM x_mk)"""


@query("E22", "market_signal_score", f"""WITH {MKT} SELECT ticker, round(composite, 6) AS composite, {sql_at_least('composite', [(b, f"'{x}'") for b, x, _ in op.MA_LIKELIHOOD], "'Low'")} AS likelihood,
  CAST({sql_at_least('composite', [(b, y) for b, _, y in op.MA_LIKELIHOOD], 0.2)} AS DOUBLE) AS probability FROM x_ms""")
def _market(t):
    return op.market_signal_score(t.market).select("ticker", r("composite"), "likelihood", "probability")


@query("E23", "anomaly_scan", f"""WITH {MKT}, z AS (SELECT ticker, composite, concat_ws('; ', CASE WHEN volume_anomaly >= 2 THEN 'volume spike' END, CASE WHEN insider >= 5 THEN 'insider buying' END,
  CASE WHEN options_activity IN ('heavy_call_buying', 'unusual_activity') THEN 'options: ' || options_activity END, CASE WHEN accumulation >= 5 THEN 'accumulation' END, CASE WHEN upgrades >= 3 THEN 'upgrades' END) AS reasons FROM x_ms)
SELECT ticker, round(composite, 6) AS composite, reasons FROM z WHERE reasons <> '' AND ticker IN (SELECT company_id FROM d_latest WHERE ma_score >= 30)""")
def _anomaly(t):
    w = t.latest.filter("ma_score >= 30").select(F.col("company_id").alias("ticker"))
    return op.anomaly_scan(t.market, w).select("ticker", r("composite"), "reasons")


WM = lambda v, w: f"coalesce(sum({v} * ({w})) / nullif(sum({w}), 0), 0)"
NEWS = lambda asof: f"(SELECT ticker, {WM('sentiment', f'relevance * greatest(0.1e0, 1 - {DAYS('published', asof)} / 30)')} AS ns, count(*) AS na FROM d_news WHERE published >= {asof} - INTERVAL 30 DAY GROUP BY 1)"
CONF = lambda asof: f"(SELECT ticker, least(10e0, avg(buzz * CAST({sql_lookup('presentation', op.PRESENTATION_WEIGHT, 1.0)} AS DOUBLE) * CAST({sql_lookup('quality', op.QUALITY_FACTOR, 1.0)} AS DOUBLE))) AS cb, count(*) AS nc FROM d_conf WHERE held >= {asof} - INTERVAL 180 DAY GROUP BY 1)"
SOC_W = lambda asof: f"engagement * greatest(0.1e0, 1 - (epoch_us({asof}) - epoch_us(ts)) / 3600000000 / 168) * CASE WHEN trending THEN 1.5e0 ELSE 1e0 END"
SOC = lambda asof: f"(SELECT ticker, {WM('sentiment', SOC_W(asof))} AS ss, sum(mentions) AS sm FROM d_social WHERE ts >= {asof} - INTERVAL 7 DAY GROUP BY 1)"


@query("D25", "news_sentiment", f"SELECT ticker, round(ns, 6) AS news_sentiment, na AS articles FROM {NEWS(TS_NOW)}")
def _news(t):
    return op.news_sentiment(t.news, NOW).select("ticker", r("news_sentiment"), "articles")


@query("D26", "conference_buzz", f"SELECT ticker, round(cb, 6) AS buzz, nc AS talks FROM {CONF(TS_NOW)}")
def _conf(t):
    return op.conference_buzz(t.conf, NOW).select("ticker", r("buzz"), "talks")


@query("D27", "social_momentum", f"SELECT ticker, round(ss, 6) AS social_sentiment, CAST(sm AS BIGINT) AS mentions FROM {SOC(TS_NOW)}")
def _social(t):
    return op.social_momentum(t.social, NOW).select("ticker", r("social_sentiment"), "mentions")


def agg_sql(now):
    return f"""x_an AS (SELECT company_id AS ticker, avg((k - 30) / 100e0) AS an FROM d_signals WHERE source_type = 'purchase' GROUP BY 1),
x_j AS (SELECT ticker, coalesce(ns, 0) AS ns, coalesce(na, 0) AS na, (coalesce(cb, 0) - 5) / 5 AS cs, coalesce(nc, 0) AS nc, coalesce(ss, 0) AS ss, coalesce(sm, 0) AS sm, coalesce(an, 0) AS an
  FROM {NEWS(now)} a FULL JOIN {CONF(now)} b USING (ticker) FULL JOIN {SOC(now)} c USING (ticker) FULL JOIN x_an USING (ticker)),
x_c AS (SELECT *, least(1e0, na / 20) AS c1, least(1e0, nc / 3) AS c2, least(1e0, sm / 100) AS c3 FROM x_j),
x_ag AS (SELECT ticker, (ns * c1 * 0.35e0 + cs * c2 * 0.25e0 + ss * c3 * 0.2e0 + an * 0.5e0 * 0.2e0) / (c1 * 0.35e0 + c2 * 0.25e0 + c3 * 0.2e0 + 0.1e0) AS ag, (c1 + c2 + c3 + 0.5) / 4 AS conf FROM x_c)"""


AGG = agg_sql(TS_NOW)
BEFORE = agg_sql(f"({TS_NOW} - INTERVAL 7 DAY)")


@query("D28", "aggregate_sentiment", f"""WITH {AGG} SELECT ticker, round(ag, 6) AS aggregate, round(conf, 6) AS confidence, {sql_at_least('round(ag, 9)', Q(op.POLARITY), "'very_negative'")} AS polarity FROM x_ag""")
def _aggregate(t):
    an = t.signals.filter("source_type = 'purchase'").groupBy(F.col("company_id").alias("ticker")).agg(F.avg((F.col("k") - 30) / 100).alias("analyst_sentiment"))
    return op.aggregate_sentiment(t.news, t.conf, t.social, an, NOW).select("ticker", r("aggregate"), r("confidence"), "polarity")


@query("D28", "sentiment_shift", f"""WITH now AS (WITH {AGG} SELECT * FROM x_ag), before AS (WITH {BEFORE} SELECT * FROM x_ag),
j AS (SELECT now.ticker, now.ag, round(now.ag - coalesce(before.ag, 0), 9) AS ch FROM now LEFT JOIN before ON before.ticker = now.ticker)
SELECT ticker, round(ag, 6) AS aggregate, round(ch, 6) AS change, CASE WHEN abs(ch) >= 0.5 THEN CASE WHEN ch > 0 THEN 'significantly improved' ELSE 'significantly deteriorated' END
  WHEN abs(ch) >= 0.3 THEN CASE WHEN ch > 0 THEN 'moderately improved' ELSE 'moderately declined' END ELSE 'stable' END AS shift FROM j""")
def _shift(t):
    an = t.signals.filter("source_type = 'purchase'").groupBy(F.col("company_id").alias("ticker")).agg(F.avg((F.col("k") - 30) / 100).alias("analyst_sentiment"))
    week_ago = str(datetime.datetime.fromisoformat(NOW) - datetime.timedelta(days=7))
    d = op.sentiment_shift(op.aggregate_sentiment(t.news, t.conf, t.social, an, NOW), op.aggregate_sentiment(t.news, t.conf, t.social, an, week_ago))
    return d.select("ticker", r("aggregate"), r("change"), "shift")


POS, NEG, DW = ["tion", "erst", "tthat", "eaux", "license", "success"], ["ich", "pass", "onst", "lig", "ung"], ["password", "copyright", "oren"]
PRES = lambda ws: "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) + ")"


@query("D29", "text_sentiment", f"""WITH x AS (SELECT source, {PRES(POS)} AS p, {PRES(NEG)} AS g, {PRES(DW)} > 0 AS deal FROM documents)
SELECT source, count(*) AS docs, round(avg(CASE WHEN p + g = 0 THEN 0 ELSE (p - g) / (p + g) END), 6) AS sentiment, count(*) FILTER (WHERE deal) AS deal_mentions FROM x GROUP BY 1""")
def _text(t):
    d = op.text_sentiment(t.documents, POS, NEG, DW)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("sentiment"), 6).alias("sentiment"), F.count_if("mentions_deal").alias("deal_mentions"))


ZW = "OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"


@query("F6", "volume_zscore", f"""SELECT symbol, CAST(day AS VARCHAR) AS day, round((volume - m) / sd, 6) AS z, CASE WHEN volume > m THEN 'high_volume' ELSE 'low_volume' END AS kind
FROM (SELECT *, avg(volume) {ZW} m, stddev_samp(volume) {ZW} sd, count(*) {ZW} c FROM d_prices) x WHERE c >= 5 AND sd > 0 AND abs((volume - m) / sd) > 2""")
def _zscore(t):
    return op.volume_zscore(t.prices).select("symbol", s("day"), r("z"), "kind")


@query("C17", "price_asof_change", f"""WITH g AS (SELECT symbol, max_by(close, day) AS cur, max_by(close, day) FILTER (WHERE day <= DATE '2001-12-01' - 200) AS prior, min_by(close, day) AS old, count(*) c FROM d_prices GROUP BY 1)
SELECT symbol, round(cur, 8) AS current, round(coalesce(prior, old), 8) AS previous, {sql_tidy('(cur - coalesce(prior, old)) / coalesce(prior, old) * 100')} AS change_pct FROM g WHERE c >= 2""")
def _asof(t):
    return op.price_change_asof(t.prices, DEAL, 200).select("symbol", r("current", 8), r("previous", 8), "change_pct")


STATUS = "CASE event_type WHEN 'signup' THEN 'NOT_YET_RECRUITING' WHEN 'view' THEN 'RECRUITING' WHEN 'click' THEN 'ACTIVE_NOT_RECRUITING' WHEN 'purchase' THEN 'COMPLETED' ELSE CASE WHEN value < 20 THEN 'TERMINATED' WHEN value < 60 THEN 'SUSPENDED' ELSE 'WITHDRAWN' END END"


@query("F7", "trial_status_change", f"""SELECT event_id, trial_id, CASE {' '.join(f"WHEN p = '{a}' AND status = '{b}' THEN '{v}'" for (a, b), v in op.STATUS_CHANGES.items())} END AS change FROM (
  SELECT *, lag(status) OVER (PARTITION BY trial_id ORDER BY ts, event_id) p FROM (SELECT event_id, ts, user_id AS trial_id, {STATUS} AS status FROM events)) x WHERE change IS NOT NULL""")
def _status(t):
    st = t.events.select("event_id", "ts", F.col("user_id").alias("trial_id"), F.expr(STATUS).alias("status"))
    return op.status_changes(st).select("event_id", "trial_id", "change")


@query("F8", "enrollment_change", f"""SELECT event_id, trial_id, previous, {sql_tidy('(enrollment - previous) * 100 / previous')} AS change_pct FROM (
  SELECT *, lag(enrollment) OVER (PARTITION BY trial_id ORDER BY ts, event_id) previous FROM (SELECT event_id, ts, user_id AS trial_id, CAST(floor(value) AS BIGINT) AS enrollment FROM events)) x
WHERE previous <> 0 AND abs((enrollment - previous) * 100 / previous) > 10""")
def _enrollment(t):
    e = t.events.select("event_id", "ts", F.col("user_id").alias("trial_id"), F.floor("value").cast("bigint").alias("enrollment"))
    return op.enrollment_changes(e).select("event_id", "trial_id", "previous", "change_pct")


@query("F14", "enrollment_velocity", """SELECT company_id, CAST(period AS VARCHAR)[1:10] AS period, round(amount, 4) AS amount, round(amount - lag(amount) OVER (PARTITION BY company_id ORDER BY period), 4) AS velocity_change
FROM (SELECT company_id, date_trunc('week', event_date) AS period, sum(CAST(value AS DECIMAL(12,2))) AS amount FROM d_signals WHERE signal_type = 'clinical_trial' GROUP BY 1, 2) x""")
def _velocity(t):
    d = t.signals.filter("signal_type = 'clinical_trial'").withColumn("ts", F.col("event_date"))
    d = op.enrollment_velocity(d, "company_id", "week", F.col("value").cast("decimal(12,2)"))
    return d.select("company_id", F.col("period").cast("date").cast("string").alias("period"), r("amount", 4), r("velocity_change", 4))


@query("F15", "price_moves", """WITH m AS (SELECT d.*, (close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1) * 100 AS mv, p_type AS sector FROM d_prices d JOIN part ON p_partkey = symbol),
a AS (SELECT sector, day, avg(mv) AS sm FROM m GROUP BY 1, 2)
SELECT symbol, CAST(m.day AS VARCHAR) AS day, round(mv, 4) AS move_pct, round(mv - sm, 4) AS relative FROM m JOIN a ON a.sector = m.sector AND a.day = m.day WHERE abs(mv) > 10""")
def _moves(t):
    sec = t.part.select(F.col("p_partkey").alias("symbol"), F.col("p_type").alias("sector"))
    return op.price_moves(t.prices, sec).select("symbol", s("day"), r("move_pct", 4), r("relative", 4))
