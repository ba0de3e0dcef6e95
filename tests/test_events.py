"""Event operators against brute force on small skewed fixtures; stream and batch give the same rows."""
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dealsight.operators import events as ev
from dealsight.streaming import alerts as al, events as st

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(i, 1 if i % 3 == 0 else rnd.randint(2, 9), T0 + timedelta(minutes=rnd.randint(0, 6000))) for i in range(400)]
    return sorted(out, key=lambda r: (r[2], r[0]))


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, company_id bigint, ts timestamp_ntz")


def triggers(rows, need, hours):
    count, last, out = {}, {}, set()
    for i, c, t in rows:
        count[c] = count.get(c, 0) + 1
        if count[c] >= need and (c not in last or t - last[c] >= timedelta(hours=hours)):
            out.add((c, i))
            count[c], last[c] = 0, t
    return out


@pytest.mark.parametrize("need,hours", [(3, 1), (2, 12), (1, 6)])
def test_rescore_triggers(df, rows, need, hours):
    got = {(r.company_id, r.event_id) for r in st.rescore_triggers(df, need=need, cooldown_hours=hours).collect()}
    assert got == triggers(rows, need, hours)


def _stream(spark, df, files=4):
    src = tempfile.mkdtemp(prefix="run-")
    parts = df.orderBy("ts", "event_id").collect()
    step = -(-len(parts) // files)
    for i in range(files):
        spark.createDataFrame(parts[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(src)
    return src


def test_rescore_stream_equals_batch(spark, df, rows):
    src, out = _stream(spark, df, 1), tempfile.mkdtemp(prefix="run-") + "/out"
    s = st.rescore_stream(st.read_events(spark, src, df.schema))
    st.run_available(s, out, tempfile.mkdtemp(prefix="run-"))
    got = {(r.company_id, r.event_id) for r in spark.read.parquet(out).collect()}
    assert got == triggers(rows, 3, 1)


def test_idempotent_stream(spark, df):
    src, out = _stream(spark, df.unionByName(df)), tempfile.mkdtemp(prefix="run-") + "/out"
    st.run_available(st.idempotent_stream(st.read_events(spark, src, df.schema, 100)), out, tempfile.mkdtemp(prefix="run-"))
    assert spark.read.parquet(out).count() == df.count()


def test_signal_window_stream_equals_batch(spark, df):
    sig = df.select("company_id", F.col("ts").alias("event_date"), F.lit("patent").alias("signal_type"), "ts", "event_id")
    src = _stream(spark, sig, 1)
    live = st.signal_window(st.read_events(spark, src, sig.schema))
    name = "window_parity"
    live.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="run-")).start().awaitTermination()
    key = lambda r: (r.company_id, r.start, r.signals)
    assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, st.signal_window_batch(sig).collect()))


def test_sessions_stream(spark, df):
    """Closed sessions of the stream are sessions of the batch twin."""
    src, out = _stream(spark, df, 1), tempfile.mkdtemp(prefix="run-") + "/out"
    live = st.activity_sessions_stream(st.read_events(spark, src, df.schema), "company_id", "ts", "3 hours", "1 hour")
    st.run_available(live, out, tempfile.mkdtemp(prefix="run-"))
    got = {(r.company_id, r.events, r.start.replace(tzinfo=None)) for r in spark.read.parquet(out).collect()}
    want = {(r.company_id, r.events, r.start) for r in st.activity_sessions(df, "company_id", "ts", "event_id", "INTERVAL 3 HOURS").collect()}
    assert got and got <= want


def test_envelope_and_routes_on_a_stream(spark):
    src = tempfile.mkdtemp(prefix="run-")
    lines = ['{"event_id":"a","timestamp":"2024-01-01T00:00:00","source":"s","event_type":"patent_cliff","payload":"{\\"company_id\\":5,\\"severity\\":\\"high\\"}","version":"1.0"}',
             '{"event_id":"b","timestamp":"2024-01-01T00:00:01","source":"s","event_type":"other","payload":"{}","version":"1.0"}', "broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").parquet(src)
    out = tempfile.mkdtemp(prefix="run-") + "/out"
    st.run_available(st.parse_envelopes(st.read_events(spark, src, "value string")).select("event_id", "is_known", "patent_cliff.company_id"), out, tempfile.mkdtemp(prefix="run-"))
    got = {(r.event_id, r.is_known, r.company_id) for r in spark.read.parquet(out).collect()}
    assert got == {("a", True, 5), ("b", False, None), (None, False, None)}


@pytest.mark.parametrize("topic,pattern,hit", [("signals.patent", "signals.*", True), ("signals.patent.new", "signals.*", False),
                                               ("signals.patent.new", "signals.#", True), ("signals", "signals.#", True), ("other", "signals.#", False)])
def test_topic_match(spark, topic, pattern, hit):
    assert spark.range(1).select(st.topic_match(F.lit(topic), pattern).alias("x")).first().x is hit


def test_first_per_ttl(spark, df, rows):
    got = {r.event_id for r in ev.first_per_ttl(df, ["company_id"], "ts", "event_id", 0.5).collect()}
    last, want = {}, set()
    for i, c, t in rows:
        if c not in last or t >= last[c] + timedelta(hours=12):
            want.add(i)
            last[c] = t
    assert got == want


def test_related_counts(df, rows):
    got = {r.event_id: (r.related, r.previous_related) for r in ev.related_counts(df, "company_id", "ts", "event_id", 1).collect()}
    for i, c, t in rows:
        before = [r for r in rows if r[1] == c and (r[2], r[0]) < (t, i) and r[2] >= t - timedelta(days=1)]
        assert got[i] == (len(before), before[-1][0] if before else None)


def test_sessions(df, rows):
    got = sorted((r.company_id, r.session_no, r.events) for r in st.activity_sessions(df, "company_id", "ts", "event_id", "INTERVAL 3 HOURS").collect())
    want, last = {}, {}
    for i, c, t in rows:
        new = c not in last or t > last[c][0] + timedelta(hours=3)
        no = 1 if c not in last else last[c][1] + (1 if new else 0)
        last[c] = (t, no)
        want[(c, no)] = want.get((c, no), 0) + 1
    assert got == sorted((c, k, n) for (c, k), n in want.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 103), (103, 101)]
    nodes = spark.createDataFrame([(i,) for i in list(range(1, 61)) + [100, 101, 103, 200]], "doc_id bigint")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r.doc_id: r.component for r in ev.components(e, nodes, "doc_id").collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == got[103] == got[100] == 100 and got[200] == 200


def test_near_duplicates_finds_copies(spark):
    base = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " tail"), (4, " ".join(f"x{i}" for i in range(200)))], "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in ev.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 1 and got[4] == 4


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src bigint, dst bigint")
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "id bigint")
    r = {x.id: x["rank"] for x in ev.pagerank(e, n, 30).collect()}
    assert sum(r.values()) == pytest.approx(1.0) and r[1] > r[4]


def test_watchlist_state(spark):
    rows = [(1, f"2024-01-{d:02d}", s) for d, s in enumerate([65.0, 70.0, 69.0, 90.0, 49.9, 60.0, 71.0, 50.0], 1)]
    d = spark.createDataFrame(rows, "company_id bigint, score_date string, score double").withColumn("score_date", F.col("score_date").cast("date"))
    got = [(r.action, r.add_score, r.peak_score) for r in st.watchlist_state(d).orderBy("score_date").collect()]
    assert got == [(None, None, None), ("added", 70, 70), ("updated", 70, 70), ("updated", 70, 90), ("removed", None, None), (None, None, None),
                   ("added", 71, 71), ("updated", 71, 71)]


def test_score_alerts(spark):
    d = spark.createDataFrame([(1, 80.0, 15.0, 0.0, "tier_1"), (2, 79.9, 14.9, 59.0, "tier_2"), (3, 85.0, None, 60.0, "tier_1"), (4, 50.0, -15.0, 65.0, "tier_3")],
                              "company_id int, score double, score_change double, previous_score double, tier string")
    got = {(r.company_id, r.alert) for r in al.score_alerts(d).collect()}
    assert got == {(1, "tier_1_candidate"), (1, "score_change"), (1, "new_candidate"), (3, "tier_1_candidate"), (4, "score_change")}


def test_subscribers(spark):
    ev_ = spark.createDataFrame([(1, "new", 70.0), (2, "new", 50.0)], "id int, event_type string, score double")
    hooks = spark.createDataFrame([("a", ["new"], None, True), ("b", ["new"], 60.0, True), ("c", ["new"], None, False)], "hook_id string, event_types array<string>, min_score double, is_active boolean")
    assert {(r.id, r.hook_id) for r in al.subscribers(ev_, hooks).collect()} == {(1, "a"), (2, "a"), (1, "b")}


def test_bad_export_format(spark):
    from dealsight.sources.landing import export_watchlist

    with pytest.raises(ValueError):
        export_watchlist(spark.range(1), "/tmp/none", "xml")


def test_watchlist_stream_equals_batch(spark):
    rnd = random.Random(5)
    rows = [(c, T0 + timedelta(days=d), float(rnd.randint(40, 90))) for c in range(1, 6) for d in range(40)]
    d = spark.createDataFrame(rows, "company_id bigint, ts timestamp_ntz, score double").withColumn("event_id", F.monotonically_increasing_id())
    src, out = _stream(spark, d, 3), tempfile.mkdtemp(prefix="run-") + "/out"
    st.run_available(st.watchlist_stream(st.read_events(spark, src, d.schema, 100)), out, tempfile.mkdtemp(prefix="run-"))
    key = lambda r: (r.company_id, r.action, r.score, r.add_score, r.peak_score)
    got = sorted(map(str, map(key, spark.read.parquet(out).collect())))
    batch = st.watchlist_state(d.withColumn("score_date", F.col("ts").cast("date"))).filter("action IS NOT NULL")
    assert got == sorted(map(str, map(key, batch.collect())))


def test_price_rollup_stream_equals_batch(spark, df):
    from dealsight.operators.reports import price_daily_rollup

    ticks = df.select(F.col("company_id").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), (F.col("event_id") % 37).cast("double").alias("price"), F.lit(1).alias("volume"), "event_id")
    src, name = _stream(spark, ticks, 1), "price_parity"
    live = st.price_rollup_stream(st.read_events(spark, src, ticks.schema))
    live.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="run-")).start().awaitTermination()
    key = lambda r: (r.symbol, r.day, r.open, r.high, r.low, r.close, r.volume)
    assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, price_daily_rollup(ticks).collect()))


def test_rss_and_atom_feeds(spark):
    from dealsight.sources.normalize import feed_entries

    rss = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>u{i}</link><description>d</description></item>" for i in range(25)) + "</channel></rss>"
    d = spark.createDataFrame([(1, rss)], "feed_id int, xml string")
    rows = feed_entries(d, kind="rss").orderBy("pos").collect()
    assert len(rows) == 20 and rows[3].title == "t3" and rows[3].updated == ""
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>a</title><link href="x"/></entry></feed>'
    r = feed_entries(spark.createDataFrame([(1, atom)], "feed_id int, xml string")).first()
    assert (r.title, r.url, r.summary) == ("a", "x", "")


def test_retention_and_partitions(spark):
    from dealsight.sources import landing as la

    d = spark.createDataFrame([("a", T0, 1), ("a", T0 - timedelta(days=3000), 2), ("b", T0, 3)], "kind string, ts timestamp_ntz, v int")
    path = la.shared_folder(spark, "landing")
    la.raw_landing(d, path, F.col("kind"), F.col("ts"))
    back = spark.read.parquet(path)
    assert back.count() == 3 and la.retained(back, "2024-01-02 00:00:00").count() == 2
    assert la.expired_partitions(back, "2024-01-02 00:00:00").count() == 1


def test_recent_errors_and_quarantine(spark):
    from dealsight.sources import landing as la

    led = spark.createDataFrame([("a", T0 + timedelta(hours=i), "x" if i % 2 else None) for i in range(30)], "source string, start_time timestamp_ntz, error string")
    rows = la.recent_errors(led).collect()
    assert len(rows) == 10 and rows[0].start_time == T0 + timedelta(hours=29)
    good, bad = la.split_bad(spark.createDataFrame([(1,), (None,), (-1,)], "v int"), F.col("v") > 0)
    assert (good.count(), bad.count()) == (1, 2)


def test_trial_cutoff_is_optional(spark):
    d = spark.createDataFrame([(1, "obesity study", ["x"], "Acme", "2030-01"), (2, "obesity study", ["x"], "State University", "2024-05-01")],
                              "trial_id int, title string, conditions array<string>, sponsor string, completion string")
    assert [r.trial_id for r in ev.trial_relevance(d, ["obesity"]).collect()] == [1, 2]
    assert [r.trial_id for r in ev.trial_relevance(d, ["obesity"], cutoff="2025-01-01").collect()] == [2]
