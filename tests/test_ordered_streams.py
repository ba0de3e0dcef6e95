"""Streams whose files hold rows out of order give the batch answer; state ends; sinks lose and repeat nothing."""
import random
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dealsight.operators.events import first_per_ttl
from dealsight.streaming import events as st, ordered as od, retry

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def streams(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    od.state_on_disk(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def new():
    return tempfile.mkdtemp(prefix="run-")


def shuffled_files(spark, rows, schema, at, jitter=50, files=4, flush=None):
    """Rows in an order that is at most ``jitter`` minutes wrong, cut into files; then a row far ahead, so that all others pass."""
    rnd, src = random.Random(1), new()
    order = sorted(rows, key=lambda r: r[at] + timedelta(minutes=rnd.randint(0, jitter)))
    step = -(-len(order) // files)
    parts = [order[i:i + step] for i in range(0, len(order), step)] + [[f] for f in (flush if isinstance(flush, list) else [flush] if flush else [])]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    return src


def events(seed=3, n=300):
    rnd = random.Random(seed)
    return [(i, 1 if i % 3 == 0 else rnd.randint(2, 9), T0 + timedelta(minutes=rnd.randint(0, 3000))) for i in range(n)]


SCHEMA = "event_id bigint, company_id bigint, ts timestamp_ntz"
END = (10**6, 10**6, T0 + timedelta(days=40))


def state_rows(query):
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])


def test_rescore_out_of_order_equals_batch(streams):
    rows = events()
    src, out = shuffled_files(streams, rows, SCHEMA, 2, flush=END), new() + "/out"
    df = streams.createDataFrame(rows, SCHEMA)
    st.run_available(od.rescore(st.read_events(streams, src, df.schema)), out, new())
    got = sorted((r.company_id, r.event_id) for r in streams.read.parquet(out).collect())
    assert got == sorted((r.company_id, r.event_id) for r in st.rescore_triggers(df).collect())


def test_rescore_state_ends_after_the_cooldown(streams):
    rows = [(k, c, T0 + timedelta(minutes=k % 3)) for c in range(20) for k in range(3)]  # every company triggers once
    src = shuffled_files(streams, rows, SCHEMA, 2, 0, 1, flush=[END, (10**6, 10**6, T0 + timedelta(days=50))])
    q = od.rescore(st.read_events(streams, src, streams.createDataFrame([], SCHEMA).schema)).writeStream.format("noop").option("checkpointLocation", new()).trigger(availableNow=True).start()
    q.awaitTermination()
    assert state_rows(q) <= 6  # the rows far ahead wait, with their timers; nothing of the twenty companies is left


def test_watchlist_out_of_order_equals_batch(streams):
    rnd = random.Random(5)
    rows = [(k, 1 + k % 7, T0 + timedelta(minutes=37 * k + k % 5), float(rnd.randint(35, 85))) for k in range(300)]
    schema = "id bigint, company_id bigint, ts timestamp_ntz, score double"
    src, out = shuffled_files(streams, rows, schema, 2, flush=(10**6, 10**6, T0 + timedelta(days=40), 10.0)), new() + "/out"
    df = streams.createDataFrame(rows, schema)
    st.run_available(od.watchlist(st.read_events(streams, src, df.schema)), out, new())
    got = sorted((r.company_id, r.us, r.action, r.add_score or -1, r.peak_score or -1) for r in streams.read.parquet(out).collect())
    want = st.watchlist_state(df, order="ts").where("action IS NOT NULL").select("company_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "action", "add_score", "peak_score")
    assert got == sorted((r.company_id, r.us, r.action, r.add_score or -1, r.peak_score or -1) for r in want.collect())


ALERTS = "alert_id bigint, company_id bigint, alert string, ts timestamp_ntz"


def alerts(n=300):
    rnd = random.Random(8)
    return [(i, 1 if i % 3 == 0 else rnd.randint(2, 5), rnd.choice(["a", "b", "score_update"]), T0 + timedelta(minutes=rnd.randint(0, 12000))) for i in range(n)]


def test_alerts_sent_equal_first_per_ttl(streams):
    rows = alerts()
    src, out = shuffled_files(streams, rows, ALERTS, 3, flush=(10**6, 10**6, "a", T0 + timedelta(days=90))), new() + "/out"
    df = streams.createDataFrame(rows, ALERTS)
    st.run_available(od.dedup_alerts(st.read_events(streams, src, df.schema)), out, new())
    got = {r.alert_id: r.sent for r in streams.read.parquet(out).collect()}
    often = df.where("alert <> 'score_update'")
    want = {r.alert_id for r in first_per_ttl(often, ["company_id", "alert"], "ts", "alert_id", 1).collect()}
    want |= {r[0] for r in df.where("alert = 'score_update'").groupBy("company_id", F.col("ts").cast("date")).agg(F.min_by("alert_id", F.struct("ts", "alert_id")).alias("i")).select("i").collect()}
    assert set(got) == {r[0] for r in rows} and {i for i, sent in got.items() if sent} == want


def test_alert_state_is_empty_a_day_after_the_last_alert(streams):
    rows = [(k, 1 + k % 9, "a", T0 + timedelta(minutes=k)) for k in range(60)]
    left = {}
    for hours in (23, 27):
        ahead = T0 + timedelta(minutes=59, hours=hours)
        src = shuffled_files(streams, rows, ALERTS, 3, 0, 1, flush=[(10**6, 10**6, "a", ahead), (10**6 + 1, 10**6, "a", ahead + timedelta(minutes=1))])
        q = od.dedup_alerts(st.read_events(streams, src, streams.createDataFrame([], ALERTS).schema), delay="0 seconds").writeStream.format("noop").option("checkpointLocation", new()).trigger(availableNow=True).start()
        q.awaitTermination()
        left[hours] = state_rows(q)
    assert left[27] < left[23]


def test_late_rows_and_the_others_are_the_input(streams):
    rnd = random.Random(2)
    rows = [(i, 1 if i % 3 == 0 else rnd.randint(2, 5), T0 + timedelta(minutes=10 * i - rnd.choice([0, 0, 0, 30, 200])), T0 + timedelta(minutes=10 * i)) for i in range(200)]
    rows = [(i ^ 1 if i % 7 == 0 else i, c, t, a) for i, c, t, a in rows]
    schema = "seq bigint, company_id bigint, ts timestamp_ntz, arrival timestamp_ntz"
    src = shuffled_files(streams, rows, schema, 3, flush=(10**6, 10**6, T0, T0 + timedelta(days=40)))
    df = streams.createDataFrame(rows, schema)
    on_time, late = new() + "/a", new() + "/b"
    od.split_late(od.arrivals(st.read_events(streams, src, df.schema)), on_time, late, new()).awaitTermination()
    a, b = streams.read.parquet(on_time), streams.read.parquet(late)
    got = sorted((r.company_id, r.seq, r.out_of_order, r.late) for r in a.unionByName(b).collect())
    want = st.late_and_out_of_order(df).select("company_id", "seq", "out_of_order", "late").collect()
    assert got == sorted(map(tuple, want)) and a.count() + b.count() == len(rows) and b.count() > 5


# ---- retries -------------------------------------------------------------------
def message(k, fails):
    return (f"m{k}", "{broken" if fails is None else f'{{"event_id": "e{k}", "source": "{fails}"}}')


def handler(df):
    """Fails a message as often as its source says, with a transient error for even ids."""
    left = F.from_json("body", "event_id string, source string").getField("source").cast("int")
    error = F.when(F.substring("message_id", -1, 1).cast("int") % 2 == 0, "TimeoutError").otherwise("ValueError")
    return df.withColumn("error_type", F.when(F.col("attempts") < left, error))


MESSAGES = [message(k, f) for k, f in enumerate([0, 1, 5, 6, None, 9, 0, 2, 6, None, 3, 0])]


def message_files(spark):
    src = new()
    for i in range(0, len(MESSAGES), 4):
        spark.createDataFrame(MESSAGES[i:i + 4], "message_id string, body string").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    return src


def outcome(spark, root):
    return {t: sorted(r.message_id for r in retry.rows(spark, root, t).collect()) for t in retry.TABLES}


WANT = {"processed": ["m0", "m1", "m10", "m11", "m2", "m6", "m7"], "rejected": ["m4", "m9"], "dead": ["m3", "m5", "m8"], "attempts": []}


def test_messages_are_tried_again_by_the_next_batch(spark):
    src, root = message_files(spark), new()
    stream = st.read_events(spark, src, spark.createDataFrame([], "message_id string, body string").schema)
    retry.run(stream, handler, root, new(), lambda n: T0).awaitTermination()
    assert retry.rows(spark, root, "attempts").count() > 0
    retry.drain(spark, handler, root, T0)
    assert outcome(spark, root) == WANT
    assert {r.attempts for r in retry.rows(spark, root, "dead").collect()} == {5}


@pytest.mark.parametrize("broken", ["rejected", "dead", "attempts"])
def test_a_run_that_ends_between_two_sinks_loses_and_repeats_nothing(spark, monkeypatch, broken):
    src, root, checkpoint = message_files(spark), new(), new()
    schema = spark.createDataFrame([], "message_id string, body string").schema
    write, calls = retry._write, []

    def fails_once(folder, name, tables):
        if name.startswith("round=000000001") and not calls:
            calls.append(name)
            for table in retry.TABLES[:retry.TABLES.index(broken)]:
                tables[table].write.mode("overwrite").parquet(f"{folder}/{table}/{name}")
            raise RuntimeError("ended between two sinks")
        write(folder, name, tables)

    monkeypatch.setattr(retry, "_write", fails_once)
    with pytest.raises(Exception, match="ended between"):
        retry.run(st.read_events(spark, src, schema), handler, root, checkpoint, lambda n: T0).awaitTermination()
    partial = outcome(spark, root)
    assert len(retry.rounds(spark, root)) == 1 and sum(map(len, partial.values())) == 4
    retry.run(st.read_events(spark, src, schema), handler, root, checkpoint, lambda n: T0).awaitTermination()
    retry.drain(spark, handler, root, T0)
    assert outcome(spark, root) == WANT


def test_replay_takes_young_transient_failures_once(spark):
    src, root = message_files(spark), new()
    stream = st.read_events(spark, src, spark.createDataFrame([], "message_id string, body string").schema)
    retry.run(stream, handler, root, new(), lambda n: T0).awaitTermination()
    retry.drain(spark, handler, root, T0)
    assert retry.replay(spark, root, T0 + timedelta(hours=25)).count() == 3
    final = retry.replay(spark, root, T0 + timedelta(hours=2))
    assert sorted(r.message_id for r in final.collect()) == ["m3", "m5"]
    assert [(r.message_id, r.attempts) for r in retry.rows(spark, root, "attempts").collect()] == [("m8", 0)]
    retry.replay(spark, root, T0 + timedelta(hours=2))
    assert retry.rows(spark, root, "attempts").count() == 1
    mended = lambda d: d.withColumn("error_type", F.lit(None).cast("string"))
    retry.drain(spark, mended, root, T0)
    assert "m8" in outcome(spark, root)["processed"] and outcome(spark, root)["attempts"] == []


def test_handler_counts_and_one_failing_handler(spark):
    src, stats, seen = new(), new() + "/s", []
    rows = [(k, "signals.a" if k % 2 else "signals.b") for k in range(20)]
    spark.createDataFrame(rows, "id int, topic string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.createDataFrame([], "id int, topic string").schema
    odd = lambda d: d.withColumn("error", F.when(F.col("id") % 4 == 1, "bad"))

    def boom(d):
        raise ValueError("no")

    handlers = {"plain": lambda d: seen.append(d.count()), "some": odd, "broken": boom, "last": lambda d: seen.append(d.count())}
    routes = {"plain": "#", "some": "signals.a", "broken": "signals.b", "last": "signals.b"}
    with pytest.raises(Exception, match="handlers failed"):
        st.route_stream(st.read_events(spark, src, schema), handlers, routes, new(), stats).awaitTermination()
    got = {r.handler: (r.processed, r.errors) for r in st.handler_stats(spark, stats).collect()}
    assert got == {"plain": (20, 0), "some": (5, 5), "broken": (0, 10), "last": (10, 0)} and seen == [20, 10]
