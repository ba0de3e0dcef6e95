"""Source, event-rule, duplicate and link queries (A, B9, B13-B17, C19-C21, C24-C25, D4, D32, D34, D35, H)."""
from pyspark.sql import functions as F

from dealsight.adapters.tpch import EVENT_AS_OF as NOW
from dealsight.functions.bands import sql_tidy
from dealsight.operators import events as ev, history as hi, reports as rp
from dealsight.plans.catalog import join_list, n, query, r, s
from dealsight.plans.deals import PAIRS
from dealsight.plans.scoring import TS_NOW
from dealsight.sources import landing as la, normalize as no

MOD6 = "['oncology', 'immunology', 'neurology', 'rare_disease', 'cardiovascular', 'metabolic']"


@query("A1", "trial_normalize", """SELECT 'NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS nct_id, md5(text) AS brief_title, lang AS overall_status, source AS lead_sponsor,
  'PHASE' || CAST(doc_id % 4 AS VARCHAR) || '|NA' AS phases, n_chars AS enrollment_count, lang || '|' || source AS conditions, 'drug-' || source || '|' || 'placebo' AS interventions FROM documents""")
def _trials(t):
    doc = F.struct(F.struct(
        F.struct(F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("nctId"), F.md5("text").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("lang").alias("overallStatus")).alias("statusModule"),
        F.struct(F.struct(F.col("source").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.array(F.concat(F.lit("PHASE"), (F.col("doc_id") % 4).cast("string")), F.lit("NA")).alias("phases"),
                 F.struct(F.col("n_chars").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.array("lang", "source").alias("conditions")).alias("conditionsModule"),
        F.struct(F.array(F.struct(F.concat(F.lit("drug-"), F.col("source")).alias("name")), F.struct(F.lit("placebo").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
    ).alias("protocolSection"))
    d = no.trial_normalize(t.documents.select(F.to_json(doc).alias("json")))
    return d.select("nct_id", "brief_title", "overall_status", "lead_sponsor", join_list("phases"), "enrollment_count", join_list("conditions"), join_list("interventions"))


SUB_TYPE = "CASE l_returnflag WHEN 'A' THEN 'ORIG' WHEN 'N' THEN 'SUPPL' ELSE 'ORIG' END"
SUB_STATUS = "CASE l_linestatus WHEN 'F' THEN 'AP' ELSE 'CR' END"
SUB_DATE = "CASE WHEN l_partkey % 11 = 0 THEN 'unknown' ELSE {fmt} END"
D_SPARK, D_DUCK = SUB_DATE.format(fmt="date_format(l_shipdate, 'yyyyMMdd')"), SUB_DATE.format(fmt="strftime(l_shipdate, '%Y%m%d')")


def applications(t):
    """One application per order; its lines are the submissions and products (an order is a bounded document)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.expr(SUB_TYPE).alias("type"), F.expr(SUB_STATUS).alias("status"), F.expr(D_SPARK).alias("status_date"))
    sub = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "type", "status", "status_date")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(sub)).alias("submissions"))
    g = g.withColumn("products", F.transform("submissions", lambda x: F.struct(F.concat(F.lit("brand-"), x["l_partkey"].cast("string")).alias("brand_name"))))
    return (g.withColumn("brand_name", F.when(F.col("l_orderkey") % 5 != 0, F.col("products")[0]["brand_name"])).withColumn("generic_name", F.lit(None).cast("string"))
            .withColumn("submissions", F.transform("submissions", lambda x: F.struct(x["type"].alias("type"), x["status"].alias("status"), x["status_date"].alias("status_date")))))


@query("A2", "fda_latest_submission", f"""WITH l AS (SELECT l_orderkey, {SUB_TYPE} AS ty, {SUB_STATUS} AS st, TRY_CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS DATE) AS d FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY d DESC, ty DESC, st DESC) rk FROM l WHERE d IS NOT NULL)
SELECT o.l_orderkey AS application, b.ty AS submission_type, b.st AS submission_status, CAST(b.d AS VARCHAR) AS status_date, o.n AS products
FROM (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) o LEFT JOIN b ON b.l_orderkey = o.l_orderkey AND rk = 1""")
def _fda(t):
    d = no.fda_latest_submission(applications(t))
    return d.select(F.col("l_orderkey").alias("application"), "submission_type", "submission_status", s("status_date"), F.size("product_names").cast("bigint").alias("products"))


@query("A3", "market_normalize", """SELECT 'financial_quote' AS entity_type, user_id AS symbol, round(value, 4) AS current_price, NULL AS industry, NULL AS close FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'financial_overview', user_id, NULL, props, NULL FROM events WHERE event_type IN ('signup', 'error') UNION ALL SELECT 'financial_historical_price', user_id, NULL, NULL, round(value, 4) FROM events WHERE event_type = 'purchase'""")
def _market_norm(t):
    kind = F.when(F.col("event_type").isin("click", "view"), "quote").when(F.col("event_type").isin("signup", "error"), "overview").otherwise("historical_price")
    v = F.col("value")
    data = F.struct(v.alias("current_price"), v.alias("market_cap"), v.alias("volume"), F.col("props").alias("industry"), v.alias("revenue"), F.col("ts").alias("date"), v.alias("close"))
    raw = t.events.select(kind.alias("type"), F.col("user_id").alias("symbol"), data.alias("data"))
    return no.market_union(no.market_normalize(raw)).select("entity_type", "symbol", r("current_price", 4), "industry", r("close", 4))


@query("A4", "ohlcv_from_parallel_arrays", """SELECT l_orderkey AS symbol, CAST(l_shipdate AS VARCHAR)[1:10] AS day, round(l_extendedprice, 4) AS open, round(l_discount, 4) AS close,
  CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) < count(*) OVER (PARTITION BY l_orderkey) THEN round(l_quantity, 4) END AS volume FROM lineitem""")
def _ohlcv(t):
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("e"))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("symbol")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    col = lambda c: F.transform("x", lambda q: q[c])
    charts = g.select("symbol", col("e").alias("timestamp"), col("l_extendedprice").alias("open"), col("l_extendedprice").alias("high"), col("l_discount").alias("low"),
                      col("l_discount").alias("close"), F.slice(col("l_quantity"), F.lit(1), F.size("x") - 1).alias("volume"))
    return no.ohlcv_bars(charts).select("symbol", F.col("bar_time").cast("date").cast("string").alias("day"), r("open", 4), r("close", 4), r("volume", 4))


@query("A5", "filing_normalize", """SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS cik, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS VARCHAR) AS filing_date, source AS company_name FROM documents
WHERE DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'""")
def _filing(t):
    idx = t.documents.select(F.col("doc_id").alias("cik"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("filing_date"), F.col("source").alias("company_name"))
    return no.filing_normalize(idx, "2024-01-10", "2024-02-10").select("cik", s("filing_date"), "company_name")


def line_documents(t, item, wrap):
    """One XML document per order from its lines."""
    g = t.lineitem.withColumn("_x", item).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("_x")), "").alias("body"))
    return g.select("l_orderkey", wrap(F.col("body")).alias("xml"))


def el(name, v):
    return F.concat(F.lit(f"<{name}>"), v.cast("string"), F.lit(f"</{name}>"))


@query("A6", "form4_transactions", """SELECT l_orderkey AS filing_id, 'owner ' || CAST(l_orderkey AS VARCHAR) AS owner, l_returnflag AS code, CAST(l_partkey AS DOUBLE) AS shares, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) END AS price, l_linestatus AS acquired_disposed FROM lineitem""")
def _form4(t):
    price = F.when(F.col("l_linenumber") == 1, F.lit("n/a")).otherwise(F.col("l_suppkey").cast("string"))
    item = el("nonDerivativeTransaction", F.concat(el("transactionCode", F.col("l_returnflag")), el("transactionShares", F.col("l_partkey")), F.lit("\n"),
                                                   el("transactionPricePerShare", price), el("transactionAcquiredDisposedCode", F.col("l_linestatus"))))
    docs = line_documents(t, item, lambda b: F.concat(F.lit("<doc><reportingOwner><rptOwnerName>owner "), F.col("l_orderkey").cast("string"), F.lit("</rptOwnerName></reportingOwner>"), b, F.lit("</doc>")))
    d = no.form4_transactions(docs.withColumnRenamed("l_orderkey", "filing_id"))
    return d.select("filing_id", "owner", "code", "shares", "price", "acquired_disposed")


@query("A7", "holdings_13f", """WITH p AS (SELECT o_custkey AS manager, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, p_brand AS issuer, sum(l_partkey) AS shares, sum(l_suppkey) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
SELECT manager, CAST(quarter AS VARCHAR) AS quarter, issuer, CAST(shares AS DOUBLE) AS shares, CAST(value AS DOUBLE) AS value,
  round((shares - lag(shares) OVER w) / nullif(lag(shares) OVER w, 0) * 100, 6) AS position_change_pct FROM p WINDOW w AS (PARTITION BY manager, issuer ORDER BY quarter)""")
def _13f(t):
    li = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    item = el("infoTable", F.concat(el("nameOfIssuer", F.concat(F.lit(" "), F.col("p_brand"))), el("value", F.col("l_suppkey")), el("shrsOrPrnAmt", F.concat(F.lit("\n"), el("sshPrnamt", F.col("l_partkey"))))))
    g = li.withColumn("_x", item).groupBy("l_orderkey").agg(F.array_join(F.collect_list("_x"), "").alias("xml"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("manager"), F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date").alias("quarter"))
    d = no.position_changes(no.holdings_13f(g.join(o, "l_orderkey")))
    return d.select("manager", s("quarter"), "issuer", "shares", "value", r("position_change_pct"))


@query("A8", "tenk_metrics", """SELECT doc_id AS filing_id, 'cash' AS metric, CAST(n_chars * 1000 AS DOUBLE) AS amount FROM documents UNION ALL SELECT doc_id, 'total_assets', CAST(n_chars * 7000 + doc_id AS DOUBLE) FROM documents
UNION ALL SELECT doc_id, 'revenue', CAST(n_chars * 20 AS DOUBLE) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'rd_expenses', CAST(doc_id + 1 AS DOUBLE) FROM documents""")
def _tenk(t):
    amt = lambda c: F.format_number(c, 0)
    rep = t.documents.select(F.col("doc_id").alias("filing_id"), F.concat(
        F.col("text"), F.lit("\nCash, cash equivalents and others $ "), amt(F.col("n_chars") * 1000), F.lit("\nTotal assets $"), amt(F.col("n_chars") * 7000 + F.col("doc_id")),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nNet sales of the year $ "), amt(F.col("n_chars") * 20))).otherwise(""),
        F.lit("\nResearch and development costs "), amt(F.col("doc_id") + 1), F.lit(" thousand")).alias("text"))
    return no.tenk_metrics(rep)


@query("A9", "feed_entries", """SELECT doc_id // 30 AS feed_id, 'entry ' || CAST(doc_id AS VARCHAR) || ' ' || md5(text) AS title, 'http://x/' || CAST(doc_id AS VARCHAR) AS url, source AS summary FROM documents""")
def _feeds(t):
    entry = F.concat(F.lit("<entry>"), el("title", F.concat(F.lit("entry "), F.col("doc_id").cast("string"), F.lit(" "), F.md5("text"))), F.lit('<link href="http://x/'),
                     F.col("doc_id").cast("string"), F.lit('"/>'), el("summary", F.col("source")), el("updated", F.lit("2024-01-01")), F.lit("</entry>"))
    g = t.documents.groupBy(F.floor(F.col("doc_id") / 30).cast("bigint").alias("feed_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("x"))
    feeds = g.select("feed_id", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.transform("x", lambda q: q["e"]), ""), F.lit("</feed>")).alias("xml"))
    return no.feed_entries(feeds).select("feed_id", "title", "url", "summary")


@query("A10", "incremental_scan", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR)[1:10] AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-25' AND o_orderdate <= TIMESTAMP '2001-08-01'")
def _scan(t):
    return no.incremental_scan(t.orders, "o_orderdate", "2001-08-01").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("A11", "raw_landing", "SELECT event_type AS source, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n FROM events GROUP BY 1, 2")
def _landing(t):
    path = la.shared_folder(t.spark, "landing")
    la.raw_landing(t.events, path, F.col("event_type"), F.col("ts"))
    back = la.retained(t.spark.read.parquet(path), NOW)
    return back.groupBy("source", "dt").agg(F.count(F.lit(1)).alias("n")).select("source", s("dt"), "n")


@query("A12", "watchlist_export", "SELECT c.company_id, ticker, round(ma_score, 6) AS ma_score FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id")
def _export(t):
    path = la.shared_folder(t.spark, "watchlist")
    e = t.companies.join(t.latest, "company_id").select("company_id", "ticker", r("ma_score"))
    la.export_watchlist(e, path, "json")
    return t.spark.read.schema("company_id bigint, ticker string, ma_score double").json(path)


@query("A12", "watchlist_export_csv", "SELECT c.company_id, ticker, round(ma_score, 6) AS ma_score FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id")
def _export_csv(t):
    path = la.shared_folder(t.spark, "watchlist-csv")
    la.export_watchlist(t.companies.join(t.latest, "company_id").select("company_id", "ticker", r("ma_score")), path, "csv")
    return t.spark.read.schema("company_id bigint, ticker string, ma_score double").option("header", True).csv(path)


@query("A12", "watchlist_export_statistics", """SELECT count(*) AS targets, round(avg(ma_score), 6) AS avg_score, round(max(ma_score), 6) AS top_score, count(*) FILTER (WHERE ma_score >= 50) AS strong
FROM d_companies c JOIN d_latest l ON l.company_id = c.company_id""")
def _export_statistics(t):
    path = la.shared_folder(t.spark, "watchlist-stats")
    e = t.companies.join(t.latest, "company_id").select("company_id", "ticker", "ma_score")
    stats = e.agg(F.count(F.lit(1)).alias("targets"), r(F.avg("ma_score")).alias("avg_score"), r(F.max("ma_score")).alias("top_score"), F.count_if(F.col("ma_score") >= 50).alias("strong"))
    la.export_watchlist(e, path, "json", stats)
    return t.spark.read.schema("targets bigint, avg_score double, top_score double, strong bigint").json(f"{path}-statistics")


LEDGER = """x_run AS (SELECT source, run, CASE WHEN hour(run) % 12 = 7 AND length(source) % 2 = 1 THEN 'timeout' END AS error FROM (SELECT DISTINCT event_type AS source FROM events),
  (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS run FROM events)),
x_got AS (SELECT event_type AS source, date_trunc('hour', ts) AS run, count(*) AS fetched, count(*) FILTER (WHERE value >= 60) AS transformed, count(*) FILTER (WHERE value >= 70) AS published, min(ts) AS start_time, max(ts) AS end_time FROM events GROUP BY 1, 2),
x_led AS (SELECT r.source, r.run, error, coalesce(fetched, 0) AS fetched, coalesce(transformed, 0) AS transformed, coalesce(published, 0) AS published, start_time, end_time FROM x_run r LEFT JOIN x_got g ON g.source = r.source AND g.run = r.run),
x_ledger AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN fetched = 0 THEN 'skipped' WHEN transformed > 0 THEN 'success' ELSE 'partial' END AS status,
  CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS BIGINT) AS duration_seconds FROM x_led)"""


def ledger(t):
    e = t.events.withColumn("source", F.col("event_type")).withColumn("run", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    ends = e.agg(F.min("run").alias("a"), F.max("run").alias("b"))
    hours = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("run"), F.lit(1).alias("_one"))
    started = e.select("source", F.lit(1).alias("_one")).distinct().join(hours, "_one").drop("_one")  # every source starts once an hour
    lost = (F.hour("run") % 12 == 7) & (F.length("source") % 2 == 1)
    return la.ingestion_ledger(e, F.col("value") >= 60, ["source", "run"], "ts", started.withColumn("error", F.when(lost, "timeout")), F.col("value") >= 70)


@query("A13", "ingestion_ledger", f"WITH {LEDGER} SELECT source, CAST(run AS VARCHAR) AS run, fetched, transformed, published, status, duration_seconds FROM x_ledger")
def _ledger(t):
    return ledger(t).select("source", F.date_format("run", "yyyy-MM-dd HH:mm:ss").alias("run"), "fetched", n("transformed"), n("published"), "status", n("duration_seconds"))


@query("D4", "ingestion_stats", f"""WITH {LEDGER} SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status = 'failed') AS failed,
  CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(transformed) AS BIGINT) AS transformed, CAST(sum(published) AS BIGINT) AS published FROM x_ledger GROUP BY 1""")
def _istats(t):
    return la.ingestion_stats(ledger(t)).select("source", "total", n("successful"), n("failed"), n("fetched"), n("transformed"), n("published"))


@query("D4", "recent_errors", f"WITH {LEDGER} SELECT source, CAST(run AS VARCHAR) AS run, error FROM x_ledger WHERE error IS NOT NULL ORDER BY run DESC, source LIMIT 10")
def _errors(t):
    led = ledger(t).withColumn("start_time", F.col("run"))
    return la.recent_errors(led).select("source", F.date_format("run", "yyyy-MM-dd HH:mm:ss").alias("run"), "error")


@query("A14", "multi_source_union", "SELECT 'documents' AS source_name, count(*) AS items FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def _union(t):
    return no.source_counts(no.multi_source_union({"documents": t.documents, "pages": t.pages, "events": t.events}))


@query("A15", "approvals_and_letters", f"""WITH l AS (SELECT *, {SUB_TYPE} AS ty, {SUB_STATUS} AS st, {D_DUCK} AS d FROM lineitem), g AS (SELECT l_orderkey, bool_or(st = 'CR') FILTER (WHERE d BETWEEN '19970101' AND '19991231') AS has_letter, count(*) FILTER (WHERE d BETWEEN '19970101' AND '19991231') AS hits FROM l GROUP BY 1),
a AS (SELECT l_orderkey, d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, ty, st, d) rk FROM l WHERE ty = 'ORIG' AND st = 'AP')
SELECT g.l_orderkey AS application, has_letter, a.d AS approval_date FROM g LEFT JOIN a ON a.l_orderkey = g.l_orderkey AND rk = 1 WHERE hits > 0 AND g.l_orderkey % 5 <> 0""")
def _approvals(t):
    return no.approvals_and_letters(applications(t), "19970101", "19991231").select(F.col("l_orderkey").alias("application"), "has_letter", "approval_date")


@query("A16", "fundamentals_flatten", "SELECT event_id AS symbol, event_type AS industry, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS employees, round(value * 1000, 4) AS market_cap, round(value, 4) AS total_cash FROM events WHERE event_type <> 'error'")
def _fundamentals(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    raw = lambda v: F.struct(v.alias("raw"))
    doc = F.struct(F.when(F.col("event_type") == "error", "Symbol not found").alias("error"), F.struct(F.col("event_type").alias("industry"), k.alias("fullTimeEmployees")).alias("assetProfile"),
                   F.struct(raw(F.col("value")).alias("totalCash")).alias("financialData"), F.struct(raw(F.col("value") * 1000).alias("marketCap")).alias("defaultKeyStatistics"))
    d = no.fundamentals_flatten(t.events.select(F.col("event_id").alias("symbol"), F.to_json(doc).alias("json")))
    return d.select("symbol", "industry", "employees", r("market_cap", 4), r("total_cash", 4))


@query("A17", "trial_search", "SELECT doc_id AS trial_id, lang FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) >= DATE '2024-01-20' ORDER BY doc_id LIMIT 1000")
def _tsearch(t):
    tr = t.documents.select(F.col("doc_id").alias("trial_id"), "lang", F.array("lang", "source").alias("conditions"), F.col("source").alias("lead_sponsor"),
                            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("last_update"))
    return no.trial_search(tr, ["en", "fr"], ["src1", "src2", "src3"], "2024-01-20").select("trial_id", "lang")


FORM = "CASE doc_id % 4 WHEN 0 THEN 'SC 13D' WHEN 1 THEN '8-K' WHEN 2 THEN 'S-4' ELSE '8-K' END"
DEALW, BIOW = ["license", "copyright", "password"], ["tion", "eaux"]
HASW = lambda ws, x="lower(text)": "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"


@query("B13", "filing_relevance", f"SELECT doc_id, {FORM} AS form_type FROM documents WHERE CASE WHEN {FORM} IN ('SC 13D', 'S-4') THEN {HASW(BIOW)} ELSE {HASW(DEALW)} END ORDER BY doc_id LIMIT 20")
def _frel(t):
    f = t.documents.select("doc_id", F.col("doc_id").alias("position"), F.expr(FORM).alias("form_type"), F.lit("").alias("title"), F.col("text").alias("summary"))
    return ev.filing_relevance(f, DEALW, BIOW).select("doc_id", "form_type")


SPON = "CASE doc_id % 3 WHEN 0 THEN 'State University' WHEN 1 THEN 'Acme Labs' ELSE 'City Hospital' END"
COMP = "CASE doc_id % 4 WHEN 0 THEN '2025-0' || CAST(1 + doc_id % 9 AS STRING) WHEN 1 THEN '2026-11-30' WHEN 2 THEN NULL ELSE '2024' END"


@query("B14", "trial_relevance", f"SELECT doc_id AS trial_id, ind AS industry_sponsored, completion FROM (SELECT doc_id, {SPON} = 'Acme Labs' AS ind, {COMP.replace('STRING', 'VARCHAR')} AS completion FROM documents WHERE {HASW(['erst', 'ich'])}) x ORDER BY ind DESC, coalesce(completion, '9999'), doc_id LIMIT 30")
def _trel(t):
    d = t.documents.select(F.col("doc_id").alias("trial_id"), F.col("text").alias("title"), F.array("lang").alias("conditions"), F.expr(SPON).alias("sponsor"), F.expr(COMP).alias("completion"))
    return ev.trial_relevance(d, ["erst", "ich"]).select("trial_id", "industry_sponsored", "completion")


MILE = "CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '-q' || CAST(quarter(o_orderdate) AS STRING) WHEN 2 THEN '1998-Q' || CAST(o_orderkey % 7 AS STRING) WHEN 3 THEN NULL ELSE 'soon' END"


@query("B9", "milestone_parse", f"""WITH m AS (SELECT o_orderkey, {MILE.replace('STRING', 'VARCHAR')} AS m FROM orders), q AS (SELECT *, upper(trim(m)) AS u, coalesce(regexp_matches(upper(trim(m)), '^[0-9]{{4}}-Q[1-4]$') AND TRY_CAST(substr(m, 1, 4) AS INT) BETWEEN 2000 AND 2100, false) AS isq FROM m)
SELECT o_orderkey, CAST(CASE WHEN isq THEN make_date(TRY_CAST(substr(u, 1, 4) AS INT), (TRY_CAST(substr(u, 7, 1) AS INT) - 1) * 3 + 1, 1) ELSE TRY_CAST(CASE WHEN regexp_matches(m, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN m END AS DATE) END AS VARCHAR) AS milestone_date,
  m IS NULL OR isq OR regexp_matches(m, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AS is_valid FROM q""")
def _milestone(t):
    d = ev.milestone_parse(t.orders.select("o_orderkey", F.expr(MILE).alias("milestone")))
    return d.select("o_orderkey", s("milestone_date"), "is_valid")


def typed_events(t):
    return t.signals.withColumn("shares", F.col("k") * 10).withColumn("price", F.col("value")).withColumn(
        "total", F.col("k") * 10 * F.col("value") + F.when(F.col("k") % 9 == 0, 5.0).otherwise(0.0)).withColumn("ticker", F.concat(F.lit("T"), F.expr("CASE WHEN k % 13 = 0 THEN '9' ELSE 'AB' END")))


@query("B15", "event_validation", """SELECT signal_id, f AS failed, f = '' AS is_valid FROM (SELECT signal_id, CASE signal_type
  WHEN 'clinical_trial' THEN concat_ws('|', CASE WHEN NOT (confidence BETWEEN 0.1 AND 1) THEN 'strength_range' END, CASE WHEN k % 13 = 0 THEN 'ticker_pattern' END)
  WHEN 'patent' THEN concat_ws('|', CASE WHEN NOT severity IN ('critical', 'high', 'medium') THEN 'severity_enum' END, CASE WHEN k % 5 = 4 THEN 'date_order' END)
  WHEN 'insider_transaction' THEN concat_ws('|', CASE WHEN k % 9 = 0 THEN 'value_is_shares_x_price' END, CASE WHEN value < 1 THEN 'price_range' END)
  ELSE '' END AS f FROM d_signals) x""")
def _validation(t):
    d = typed_events(t)
    rules = {
        "clinical_trial": {"strength_range": F.col("confidence").between(0.1, 1.0), "ticker_pattern": F.col("ticker").rlike("^[A-Z]{1,5}$")},
        "patent": {"severity_enum": F.col("severity").isin("critical", "high", "medium"),
                   "date_order": F.col("event_date") + F.when(F.col("k") % 5 == 4, F.expr("INTERVAL -1 DAY")).otherwise(F.expr("INTERVAL 30 DAY")) > F.col("event_date")},
        "insider_transaction": {"value_is_shares_x_price": F.abs(F.col("total") - F.col("shares") * F.col("price")) <= 0.01, "price_range": F.col("price") >= 1},
    }
    return ev.event_validation(d, "signal_type", rules).select("signal_id", join_list("failed"), "is_valid")


@query("B16", "data_quality_score", """WITH x AS (SELECT source, (n_chars < 200)::INT + (doc_id % 10 = 0)::INT AS e, (lang = 'de')::INT + (length(text) > 3000)::INT AS w FROM documents)
SELECT source, count(*) AS n, round(avg(greatest(0e0, least(1e0, 1 - 0.2e0 * e - 0.05e0 * w))), 6) AS quality, count(*) FILTER (WHERE e > 0) AS rejected FROM x GROUP BY 1""")
def _quality(t):
    cik = F.when(F.col("doc_id") % 10 == 0, "12AB").otherwise(F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    d = ev.data_quality(t.documents.withColumn("cik", cik), {"length": F.col("n_chars") >= 200, "cik": F.col("cik").rlike(r"^\d{10}$")},
                        {"lang": F.col("lang") != "de", "size": F.length("text") <= 3000})
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.count_if("rejected").alias("rejected"))


@query("B17", "alert_rule_match", """SELECT r.rid AS rule_company, s.signal_id FROM d_signals s JOIN (SELECT company_id AS rid, CASE signal WHEN 0 THEN 'patent' WHEN 1 THEN 'hiring' ELSE 'financial' END AS ty, 150 + nation_no * 4 AS th, CASE WHEN company_id % 3 = 0 THEN NULL ELSE company_id END AS only_company
  FROM (SELECT *, company_id % 3 AS signal FROM d_companies WHERE nation_no < 6) q) r ON r.ty = s.signal_type AND s.value >= r.th AND (r.only_company IS NULL OR r.only_company = s.company_id)""")
def _rules(t):
    from dealsight.streaming.alerts import alert_rule_match

    kind = F.expr("CASE company_id % 3 WHEN 0 THEN 'patent' WHEN 1 THEN 'hiring' ELSE 'financial' END")
    rules = t.companies.select(F.col("company_id").alias("rule_id"), F.array(kind).alias("signal_types"), (150 + F.col("nation_no") * 4).cast("double").alias("threshold"),
                               F.when(F.col("company_id") % 3 != 0, F.array("company_id")).alias("companies"), (F.col("nation_no") < 6).alias("is_active"))
    return alert_rule_match(t.signals, rules).select(F.col("rule_id").alias("rule_company"), "signal_id")


ENT = "CASE doc_id % 4 WHEN 0 THEN 'sec_filing' WHEN 1 THEN 'clinical_trial' WHEN 2 THEN 'fda_approval' ELSE 'financial_quote' END"


@query("H1", "event_dedup_hash", f"""WITH h AS (SELECT source, doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN '{{"accession_number":"' || md5(text) || '","entity_type":"sec_filing","source":"' || source || '"}}'
  WHEN 1 THEN '{{"entity_type":"clinical_trial","nct_id":"NCT' || CAST(n_chars // 100 AS VARCHAR) || '","source":"' || source || '"}}'
  WHEN 2 THEN '{{"application_number":"NDA' || CAST(n_chars // 50 AS VARCHAR) || '","entity_type":"fda_approval","source":"' || source || '"}}'
  ELSE '{{"date":"' || lang || '","entity_type":"financial_quote","source":"' || source || '","symbol":"' || source || '"}}' END) AS event_hash FROM documents)
SELECT source, event_hash, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY 1, 2""")
def _dedup(t):
    e = F.expr(ENT)
    only = lambda kind, v: F.when(e == kind, v)
    h = ev.event_hash({"source": F.col("source"), "entity_type": e, "accession_number": only("sec_filing", F.md5("text")),
                       "nct_id": only("clinical_trial", F.concat(F.lit("NCT"), F.floor(F.col("n_chars") / 100).cast("string"))),
                       "application_number": only("fda_approval", F.concat(F.lit("NDA"), F.floor(F.col("n_chars") / 50).cast("string"))),
                       "symbol": only("financial_quote", F.col("source")), "date": only("financial_quote", F.col("lang"))})
    return ev.first_per_hash(t.documents.select("source", "doc_id", h.alias("event_hash")), "source", "event_hash", "doc_id")


@query("H2", "content_dedup_ttl", """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id FROM events),
k AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL
  SELECT k.user_id, k.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 7 DAY) FROM k WHERE k.ts IS NOT NULL)
SELECT e.user_id, e.event_type, min(e.event_id) AS event_id FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts = k.ts GROUP BY 1, 2, e.ts""")
def _ttl(t):
    return ev.first_per_ttl(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id", 7).select("user_id", "event_type", "event_id")


@query("H3", "news_title_dedup", f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(substr(text, 1, 50)) ORDER BY doc_id) rk FROM documents WHERE {HASW(DEALW + BIOW, "lower(substr(text, 1, 80) || ' ' || text)")}) x WHERE rk = 1 ORDER BY doc_id LIMIT 20""")
def _title(t):
    a = t.documents.select("doc_id", F.col("doc_id").alias("position"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("description"))
    return ev.title_dedup(a, DEALW + BIOW).select("doc_id")


@query("H4", "news_near_dup", """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM h a JOIN h b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x AS s, y AS d FROM o JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE common * 100 >= 75 * (p.n + q.n - common)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.d, r.c FROM r JOIN e ON e.s = r.id)
SELECT id AS doc_id, min(c) AS component FROM r GROUP BY 1""")
def _near(t):
    return ev.near_duplicates(t.documents)


@query("H6", "missing_data_gaps", """SELECT u AS user_id, CAST(d AS VARCHAR) AS day FROM (SELECT DISTINCT user_id AS u FROM events), (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d)
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = u AND CAST(ts AS DATE) = d)""")
def _gaps(t):
    return ev.missing_days(t.events, "user_id", "ts", "2024-01-01", "2024-01-30").select("user_id", s("day"))


@query("C19", "related_events_30d", """SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 3 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))) AS related,
  CASE WHEN lag(ts) OVER w >= ts - INTERVAL 3 DAY THEN lag(event_id) OVER w END AS previous_related FROM events a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _related(t):
    d = ev.related_counts(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3)
    return d.select("event_id", n("related"), "previous_related")


SPONSOR = """CASE o_orderkey % 5 WHEN 0 THEN 'Supplier#' || lpad(CAST(o_custkey AS STRING), 9, '0') WHEN 1 THEN 'SUPPLIER ' || lpad(CAST(o_custkey AS STRING), 9, '0') || ', Inc.'
  WHEN 2 THEN 'Supplir ' || lpad(CAST(o_custkey AS STRING), 9, '0') WHEN 3 THEN 'Suplier Corp ' || lpad(CAST(o_custkey AS STRING), 9, '0') ELSE 'Nobody ' || CAST(o_custkey AS STRING) END"""
NORM = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\\b(inc|corp|corporation|ltd|llc|plc|co)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("C20", "entity_resolution", f"""WITH nm AS (SELECT DISTINCT {SPONSOR.replace('STRING', 'VARCHAR')} AS sponsor FROM orders), q AS (SELECT sponsor, {NORM('sponsor')} AS norm FROM nm), c AS (SELECT company_id, {NORM('name')} AS cn FROM d_companies),
f AS (SELECT sponsor, min(struct_pack(d := levenshtein(norm, cn), id := company_id)) AS m FROM q JOIN c ON levenshtein(norm, cn) <= 2 GROUP BY 1)
SELECT q.sponsor, coalesce(e.company_id, m.id) AS company_id, CASE WHEN e.company_id IS NOT NULL THEN 'exact' WHEN m IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS how
FROM q LEFT JOIN c e ON e.cn = q.norm LEFT JOIN f ON f.sponsor = q.sponsor""")
def _entity(t):
    return ev.entity_resolution(t.orders.select(F.expr(SPONSOR).alias("sponsor")), t.companies).select("sponsor", "company_id", "how")


CITE = "SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem"


def _rank_sql(k):
    steps = ["e AS (" + CITE + ")", "dg AS (SELECT src, count(*) AS deg FROM e GROUP BY 1)", "nn AS (SELECT count(*) AS n FROM part)",
             "r0 AS (SELECT p_partkey AS id, 1e0 / n AS rk, deg FROM part CROSS JOIN nn LEFT JOIN dg ON src = p_partkey)"]
    for i in range(k):
        steps.append(f"r{i + 1} AS (SELECT a.id, a.deg, 0.15e0 / n + 0.85e0 * (coalesce(x.v, 0) + (SELECT coalesce(sum(rk), 0) FROM r{i} WHERE deg IS NULL) / n) AS rk FROM r{i} a CROSS JOIN nn LEFT JOIN (SELECT dst, sum(rk / deg) AS v FROM e JOIN r{i} ON id = src GROUP BY 1) x ON x.dst = a.id)")
    return "WITH " + ", ".join(steps) + f" SELECT id AS part_id, round(rk * 1000, 8) AS rank_k FROM r{k}"


@query("C21", "citation_pagerank", _rank_sql(5))
def _pagerank(t):
    parts = F.broadcast(t.part.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1)))
    e = (t.lineitem.withColumn("_one", F.lit(1)).join(parts, "_one")
         .select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("_n")).alias("dst")))
    return ev.pagerank(e, t.part.select(F.col("p_partkey").alias("id")), 5).select(F.col("id").alias("part_id"), r(F.col("rank") * 1000, 8).alias("rank_k"))


@query("C24", "event_correlation", """SELECT event_id, CAST((event_id >= 1)::INT + (event_id >= 2)::INT + 0 AS BIGINT) AS found, event_id >= 7 AS cause_found, event_id % 4 <> 0 AND event_id >= 2 AS counts_agree FROM events""")
def _correlation(t):
    e = t.events.select("event_id", "ts", "event_type", F.col("user_id").alias("correlation_id"), (F.col("event_id") - 7).alias("causation_id"),
                        F.array(F.col("event_id") - 1, F.col("event_id") - 2).alias("contributing"), F.when(F.col("event_id") % 4 == 0, 3).otherwise(2).alias("declared"))
    return ev.event_correlation(e).select("event_id", n("found"), "cause_found", "counts_agree")


@query("C25", "approval_trial_link", """WITH tr AS (SELECT l_orderkey AS trial_id, l_suppkey AS sponsor, l_partkey AS drug FROM lineitem), pr AS (SELECT sponsor, drug, min(trial_id) AS t FROM tr GROUP BY 1, 2),
ap AS (SELECT o_orderkey AS approval_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS ref, o_custkey % 100 AS sponsor, o_orderkey % 2000 AS drug FROM orders)
SELECT approval_id, coalesce(k.trial_id, pr.t) AS trial_id, CASE WHEN k.trial_id IS NOT NULL THEN 'trial_id' WHEN pr.t IS NOT NULL THEN 'sponsor_drug' ELSE 'none' END AS how
FROM ap LEFT JOIN (SELECT DISTINCT trial_id FROM tr) k ON k.trial_id = ap.ref LEFT JOIN pr ON pr.sponsor = ap.sponsor AND pr.drug = ap.drug""")
def _link(t):
    tr = t.lineitem.select(F.col("l_orderkey").alias("trial_id"), F.col("l_suppkey").alias("sponsor"), F.col("l_partkey").alias("drug"))
    ap = t.orders.select(F.col("o_orderkey").alias("approval_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("trial_ref"),
                         (F.col("o_custkey") % 100).alias("sponsor"), (F.col("o_orderkey") % 2000).alias("drug"))
    return ev.approval_trial_link(ap, tr).select("approval_id", "trial_id", "how")


@query("D32", "price_daily_rollup", """SELECT user_id AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(arg_min(value, ts), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, ts), 4) AS close,
  CAST(sum(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)) AS BIGINT) AS volume, round(avg(value), 6) AS vwap FROM events GROUP BY 1, 2""")
def _daily(t):
    ticks = t.events.select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"), F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("volume"))
    return rp.price_daily_rollup(ticks).select("symbol", s("day"), r("open", 4), r("high", 4), r("low", 4), r("close", 4), n("volume"), r("vwap"))


AREA6 = ["oncology", "immunology", "neurology", "rare_disease", "cardiovascular", "metabolic"]


@query("D34", "sector_heatmap", "SELECT acquirer_type, " + ", ".join(f"count(*) FILTER (WHERE area = '{a}') AS {a}" for a in AREA6) + " FROM d_deals d JOIN d_acquirers a ON a.acquirer_id = d.acquirer_id GROUP BY 1")
def _heat(t):
    p = t.deals.join(t.acquirers.select("acquirer_id", "acquirer_type"), "acquirer_id")
    return rp.sector_heatmap(p, "acquirer_type", "area", AREA6, F.count(F.lit(1)))


@query("D34", "sector_cube", "SELECT area, stage, structure, count(*) AS n, round(sum(deal_value) / 1e6, 2) AS value FROM d_deals GROUP BY CUBE (area, stage, structure)")
def _cube(t):
    d = rp.sector_cube(t.deals, ["area", "stage", "structure"], F.sum(F.col("deal_value").cast("decimal(24,2)")).cast("double") / 1e6)
    return d.select("area", "stage", "structure", "n", r("value", 2))


@query("D35", "run_summaries", f"""WITH {PAIRS}, ch AS (SELECT company_id, score, coalesce(score - lag(score) OVER (PARTITION BY company_id ORDER BY score_date), 0) AS c, row_number() OVER (PARTITION BY company_id ORDER BY score_date DESC) rk FROM d_scores)
SELECT count(*) AS companies, count(*) FILTER (WHERE abs(c) > 10) AS significant, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, (SELECT count(DISTINCT company_id) FROM x_match) AS targets, (SELECT count(*) FROM x_match) AS matches,
  round((SELECT count(*) / count(DISTINCT company_id) FROM x_match), 6) AS matches_per_target FROM ch WHERE rk = 1""")
def _runs(t):
    from dealsight.operators import matching as ma

    sc = hi.latest(hi.score_trend(t.scores))
    m = ma.match_acquirers(t.companies.select("company_id", "areas"), t.acquirers, t.deals)
    return rp.run_summary(sc, m).select("companies", n("significant"), r("avg_score"), r("max_score"), "targets", "matches", r("matches_per_target"))
