"""Raw source documents to canonical rows.

Each function is a narrow transform over a corpus of documents (one row per
document): arrays inside one document are bounded by that document.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from dealsight.functions.clock import at
from dealsight.functions.scale import top_per_key

TRIAL_SCHEMA = """struct<protocolSection:struct<
  identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,
  statusModule:struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>>,
  sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,
  designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:bigint>>,
  conditionsModule:struct<conditions:array<string>>,
  armsInterventionsModule:struct<interventions:array<struct<name:string>>>,
  outcomesModule:struct<primaryOutcomes:array<struct<measure:string>>>>>"""

FUNDAMENTALS_SCHEMA = """struct<error:string,assetProfile:struct<industry:string,sector:string,fullTimeEmployees:bigint>,
  financialData:struct<totalCash:struct<raw:double>,totalDebt:struct<raw:double>,totalRevenue:struct<raw:double>,cashPerShare:struct<raw:double>>,
  defaultKeyStatistics:struct<marketCap:struct<raw:double>,enterpriseValue:struct<raw:double>>>"""

EMPTY = lambda: F.array().cast("array<string>")


def trial_normalize(raw: DataFrame, json: str = "json") -> DataFrame:
    """A1: nested registry JSON to one flat trial row."""
    p = F.from_json(F.col(json), TRIAL_SCHEMA).getField("protocolSection")
    g = lambda path: p.getField(path.split(".")[0]) if "." not in path else _path(p, path)
    arr = lambda path: F.coalesce(g(path), EMPTY())
    names = F.coalesce(F.transform(g("armsInterventionsModule.interventions"), lambda i: i["name"]), EMPTY())
    return raw.select(
        "*", g("identificationModule.nctId").alias("nct_id"), g("identificationModule.briefTitle").alias("brief_title"),
        g("statusModule.overallStatus").alias("overall_status"), g("statusModule.lastUpdatePostDateStruct.date").alias("last_update"),
        g("sponsorCollaboratorsModule.leadSponsor.name").alias("lead_sponsor"), g("designModule.studyType").alias("study_type"),
        arr("designModule.phases").alias("phases"), g("designModule.enrollmentInfo.count").alias("enrollment_count"),
        arr("conditionsModule.conditions").alias("conditions"), names.alias("interventions")).drop(json)


def _path(col: Column, path: str) -> Column:
    for part in path.split("."):
        col = col.getField(part)
    return col


def parsed_date(text: Column, fmt: str = "yyyyMMdd") -> Column:
    return F.try_to_date(text, fmt)


def fda_latest_submission(apps: DataFrame) -> DataFrame:
    """A2: submission with the greatest valid status date, and flat products."""
    dated = F.filter(F.transform("submissions", lambda s: F.struct(parsed_date(s["status_date"]).alias("d"), s.alias("s"))),
                     lambda x: x["d"].isNotNull())
    last = F.array_max(dated)
    return (apps.withColumn("_l", last)
            .withColumn("submission_type", F.col("_l.s.type")).withColumn("submission_status", F.col("_l.s.status"))
            .withColumn("status_date", F.col("_l.d")).drop("_l")
            .withColumn("product_names", F.transform("products", lambda p: p["brand_name"])))


def market_normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """A3: tagged union to three typed tables that share the base columns."""
    base = [F.lit("financial_data").alias("source"), F.concat(F.lit("financial_"), F.col("type")).alias("entity_type"), F.col("symbol")]
    fields = {"quote": ["current_price", "market_cap", "volume"], "overview": ["industry", "market_cap", "revenue"],
              "historical_price": ["date", "close", "volume"]}
    return {tag: raw.filter(F.col("type") == tag).select(*base, *[F.col("data").getField(c).alias(c) for c in cols]) for tag, cols in fields.items()}


def market_union(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for d in tables.values():
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def ohlcv_bars(charts: DataFrame, key: str = "symbol") -> DataFrame:
    """A4: parallel arrays to one row per bar; short arrays give NULL."""
    cols = ["timestamp", "open", "high", "low", "close", "volume"]
    z = F.arrays_zip(*[F.col(c) for c in cols])
    return (charts.select(key, F.inline(z)).filter(F.col("timestamp").isNotNull())
            .withColumn("bar_time", F.timestamp_seconds("timestamp")).drop("timestamp"))


def filing_normalize(index: DataFrame, start: str, end: str) -> DataFrame:
    """A5: padded identifiers and an inclusive date window."""
    d = index.withColumn("filing_date", F.to_date("filing_date")).filter(F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return d.withColumn("cik", F.lpad(F.col("cik").cast("string"), 10, "0")).withColumn("source", F.lit("sec_edgar")).withColumn("entity_type", F.lit("sec_filing"))


def tag(text: Column, name: str) -> Column:
    """First value of an XML tag, NULL when absent."""
    v = F.regexp_extract(text, f"(?s)<{name}>(.*?)</{name}>", 1)
    return F.when(v != "", v)


def tags(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def form4_transactions(filings: DataFrame, key: str = "filing_id", xml: str = "xml") -> DataFrame:
    """One row per non-derivative transaction of each ownership filing."""
    d = filings.select(key, tag(tag(F.col(xml), "reportingOwner"), "rptOwnerName").alias("owner"),
                       F.posexplode(tags(F.col(xml), "nonDerivativeTransaction")).alias("pos", "_t"))
    t = F.col("_t")
    return d.select(key, "owner", "pos", tag(t, "transactionCode").alias("code"), tag(t, "transactionDate").alias("transaction_date"),
                    tag(t, "transactionShares").try_cast("double").alias("shares"), tag(t, "transactionPricePerShare").try_cast("double").alias("price"),
                    tag(t, "transactionAcquiredDisposedCode").alias("acquired_disposed"))


def holdings_13f(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Positions of each holdings filing (manager, quarter)."""
    d = filings.select("manager", "quarter", F.explode(tags(F.col(xml), "infoTable")).alias("_t"))
    t = F.col("_t")
    return d.select("manager", "quarter", F.trim(tag(t, "nameOfIssuer")).alias("issuer"),
                    tag(tag(t, "shrsOrPrnAmt"), "sshPrnamt").try_cast("double").alias("shares"), tag(t, "value").try_cast("double").alias("value"))


def position_changes(positions: DataFrame) -> DataFrame:
    """Quarter-over-quarter change per (manager, issuer); one row per quarter after aggregation."""
    from pyspark.sql import Window as W

    q = positions.groupBy("manager", "issuer", "quarter").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))
    prev = F.lag("shares").over(W.partitionBy("manager", "issuer").orderBy("quarter"))
    return q.withColumn("position_change_pct", F.try_divide(F.col("shares") - prev, prev) * 100)


# fixed values: labels followed by the first amount in the report
TENK_LABELS = {
    "cash": r"Cash[,\s]+[Cc]ash [Ee]quivalents.*?[\$\s]+([\d,]+)",
    "total_assets": r"Total [Aa]ssets.*?[\$\s]+([\d,]+)",
    "revenue": r"(?:Revenue|Net [Ss]ales).*?[\$\s]+([\d,]+)",
    "rd_expenses": r"Research and [Dd]evelopment.*?[\$\s]+([\d,]+)",
}


def tenk_metrics(reports: DataFrame, key: str = "filing_id", text: str = "text", labels: Mapping[str, str] = TENK_LABELS) -> DataFrame:
    """First amount after each label, in long form."""
    vals = [F.regexp_replace(F.regexp_extract(text, pat, 1), ",", "").try_cast("double").alias(m) for m, pat in labels.items()]
    return reports.select(key, *vals).unpivot([key], list(labels), "metric", "amount").filter("amount IS NOT NULL")


ATOM = "struct<entry:array<struct<title:string,link:struct<_href:string>,summary:string,updated:string>>>"
RSS = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>>"


def feed_entries(feeds: DataFrame, key: str = "feed_id", xml: str = "xml", kind: str = "atom", limit: int | None = None) -> DataFrame:
    """Entries of each feed document; of an RSS channel the first ``limit`` (20 unless given), of an Atom feed all unless given."""
    limit = 20 if limit is None and kind == "rss" else limit
    doc = F.from_xml(F.col(xml), ATOM if kind == "atom" else RSS)
    items = doc.getField("entry") if kind == "atom" else doc.getField("channel").getField("item")
    d = feeds.select(key, F.posexplode(items if limit is None else F.slice(items, 1, limit)).alias("pos", "_e"))
    e = lambda c: F.coalesce(F.col(f"_e.{c}"), F.lit(""))
    if kind == "atom":
        return d.select(key, "pos", e("title").alias("title"), e("link._href").alias("url"), e("summary").alias("summary"), e("updated").alias("updated"))
    return d.select(key, "pos", e("title").alias("title"), e("link").alias("url"), e("description").alias("summary"), e("pubDate").alias("updated"))


def incremental_scan(df: DataFrame, ts: str, end, last_fetch=None, days: int = 7, start=None) -> DataFrame:
    """A10: rows of (start, end]; the start defaults to the last fetch, else N days back."""
    lo = at(start) if start is not None else at(last_fetch) if last_fetch is not None else at(end) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) <= at(end)))


def multi_source_union(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Tag rows by source and concatenate."""
    out = None
    for name, d in sources.items():
        d = d.withColumn("source_name", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def gather_sources(loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all sources that load, and the error of each that does not; one failure stops no other source."""
    loaded, failures = {}, {}
    for name, load in loaders.items():
        try:
            loaded[name] = load()
        except (PySparkException, OSError) as e:
            failures[name] = str(e).splitlines()[0]
    return (multi_source_union(loaded) if loaded else None), failures


def source_counts(union: DataFrame) -> DataFrame:
    return union.groupBy("source_name").agg(F.count(F.lit(1)).alias("items"))


def in_window(submissions: str, start: str, end: str) -> Column:
    return F.filter(F.col(submissions), lambda s: s["status_date"].between(start, end))


def approvals_and_letters(apps: DataFrame, start: str, end: str) -> DataFrame:
    """Applications with a submission in the window, letter flag, approval date; nameless rows dropped."""
    hits = in_window("submissions", start, end)
    orig = F.filter("submissions", lambda s: (s["type"] == "ORIG") & (s["status"] == "AP"))
    d = apps.filter(F.size(hits) > 0)
    d = (d.withColumn("has_letter", F.exists(hits, lambda s: s["status"] == "CR"))
         .withColumn("approval_date", F.try_element_at(orig, F.lit(1)).getField("status_date")))
    named = (F.coalesce("brand_name", F.lit("")) != "") | (F.coalesce("generic_name", F.lit("")) != "")
    return d.filter(named)


def fundamentals_flatten(raw: DataFrame, json: str = "json") -> DataFrame:
    """Nested {raw: x} leaves to one row per symbol; error rows dropped."""
    d = raw.withColumn("_d", F.from_json(F.col(json), FUNDAMENTALS_SCHEMA)).filter(F.col("_d.error").isNull())
    return d.select("symbol", F.col("_d.assetProfile.industry").alias("industry"), F.col("_d.assetProfile.fullTimeEmployees").alias("employees"),
                    F.col("_d.defaultKeyStatistics.marketCap.raw").alias("market_cap"), F.col("_d.defaultKeyStatistics.enterpriseValue.raw").alias("enterprise_value"),
                    F.col("_d.financialData.totalCash.raw").alias("total_cash"), F.col("_d.financialData.totalDebt.raw").alias("total_debt"),
                    F.col("_d.financialData.totalRevenue.raw").alias("revenue"))


def trial_search(trials: DataFrame, conditions: Sequence[str] = (), sponsors: Sequence[str] = (), updated_after=None, limit: int | None = 1000) -> DataFrame:
    """Any condition AND any sponsor AND updated after, at most ``limit`` rows."""
    d = trials
    if conditions:
        d = d.filter(F.arrays_overlap("conditions", F.array(*[F.lit(c) for c in conditions])))
    if sponsors:
        d = d.filter(F.col("lead_sponsor").isin(list(sponsors)))
    if updated_after is not None:
        d = d.filter(F.col("last_update") >= F.lit(updated_after).cast("date"))
    return d if limit is None else d.orderBy("trial_id").limit(limit)


# Named source transforms, used through df.transform
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {"clinical_trials": trial_normalize, "fda": fda_latest_submission, "fundamentals": fundamentals_flatten}


def register_transform(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    TRANSFORMS[name] = fn


def normalize_sources(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every raw source through the transform registered under its name; a source without one is an error."""
    missing = sorted(set(raw) - set(TRANSFORMS))
    if missing:
        raise KeyError(f"no transform registered for {', '.join(missing)}")
    return {name: df.transform(TRANSFORMS[name]) for name, df in raw.items()}
