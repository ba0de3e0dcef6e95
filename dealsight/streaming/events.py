"""Event-stream operators.

Functions here take and return DataFrames and run on both batch and streaming
input unless they say otherwise; stateful ones have a batch twin with the same
results that never sorts one key in one task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from dealsight.functions.bands import first_match, tidy
from dealsight.functions.clock import at, micros_between
from dealsight.functions.scale import count_before, cut, exact_quantiles, previous_values, reachable, running_max, running_sum, sliced
from dealsight.operators.events import first_per_ttl

ENVELOPE = "event_id string, timestamp timestamp_ntz, source string, event_type string, payload string, version string, correlation_id string"
# payload fields by event type
PAYLOADS = {
    "clinical_trial_signal": "company_id bigint, trial_id string, signal_type string, signal_strength double",
    "patent_cliff": "company_id bigint, drug_name string, severity string, estimated_revenue_impact double",
    "insider_activity": "company_id bigint, transaction_type string, shares bigint, transaction_value double",
    "hiring_signal": "company_id bigint, signal_type string, job_count bigint",
    "ma_candidate": "company_id bigint, overall_score double, tier string, previous_score double, score_change double",
    "report_generated": "report_type string, report_title string",
}
RETRIABLE = ["RateLimitError", "TimeoutError", "ConnectionError", "ServiceUnavailable"]
MAX_RETRIES = 5


def read_events(spark: SparkSession, folder: str, schema, max_files: int = 1) -> DataFrame:
    """File-source stream of parquet event files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available once and stop."""
    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()


def watermarked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; zone-free event times are read in the session zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def parse_envelopes(raw: DataFrame, col: str = "value") -> DataFrame:
    """JSON envelope to typed payload; an unknown type keeps the base fields only."""
    d = raw.withColumn("_e", F.from_json(F.col(col), ENVELOPE)).select("*", "_e.*").drop("_e")
    for kind, schema in PAYLOADS.items():
        d = d.withColumn(kind, F.when(F.col("event_type") == kind, F.from_json("payload", schema)))
    return d.withColumn("is_known", F.coalesce(F.col("event_type").isin(list(PAYLOADS)), F.lit(False)))


def topic_match(topic: Column, pattern: str) -> Column:
    """One pattern: ``*`` is one word, ``#`` any number of words."""
    rx = "^" + pattern.replace(".", r"\.").replace("*", r"[^.]+").replace(r"\.#", r"(\..*)?").replace("#", ".*") + "$"
    return topic.rlike(rx)


def topic_routing(events: DataFrame, routes: Mapping[str, str], topic: str = "topic") -> DataFrame:
    """One row per matching handler; ``routes`` maps handler to pattern."""
    hit = F.array(*[F.when(topic_match(F.col(topic), p), F.lit(h)) for h, p in routes.items()])
    return events.withColumn("handler", F.explode(F.filter(hit, lambda x: x.isNotNull())))


def route_stream(events: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame | None]], routes: Mapping[str, str], checkpoint: str,
                 stats: str | None = None):
    """Fan a stream out to per-handler callables batch by batch; a batch is read once.

    A handler may return its events with ``error``, null where all went well; else all of them count as processed.  If it
    raises, all count as errors, the other handlers still run, and the batch fails after that.  ``stats`` is a folder for the
    counts: (handler, processed, errors) for each batch, written again if the batch is run again.
    """
    def each(batch: DataFrame, number: int) -> None:
        held, counts, raised = batch.persist(), [], []
        try:
            for h, fn in handlers.items():
                own = held.filter(topic_match(F.col("topic"), routes[h]))
                try:
                    done = fn(own)
                    errors = 0 if done is None else done.filter(F.col("error").isNotNull()).count()
                except Exception as e:  # counted, then raised for all handlers together
                    raised.append(e)
                    errors = None
                n = own.count()
                counts.append((h, 0, n) if errors is None else (h, n - errors, errors))
            if stats:
                batch.sparkSession.createDataFrame(counts, "handler string, processed long, errors long").coalesce(1).write.mode("overwrite").parquet(f"{stats}/batch={number}")
        finally:
            held.unpersist()
        if raised:
            raise ExceptionGroup("handlers failed", raised)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def handler_stats(spark: SparkSession, stats: str) -> DataFrame:
    """Processed and failed events of every handler, over all batches."""
    return spark.read.parquet(stats).groupBy("handler").agg(F.sum("processed").alias("processed"), F.sum("errors").alias("errors"))


def signal_window(signals: DataFrame, types: Sequence[str] = (), watermark: str | None = None) -> DataFrame:
    """Signals per company in sliding 24 h windows that start each hour."""
    d = signals.filter(F.col("signal_type").isin(list(types))) if types else signals
    if watermark:
        d = watermarked(d, "event_date", watermark)
    w = F.window("event_date", "24 hours", "1 hour")
    return d.groupBy("company_id", w).agg(F.count(F.lit(1)).alias("signals")).select("company_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "signals")


def signal_window_batch(signals: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """I3 batch twin: hourly counts first, then 24 windows per hour instead of per event."""
    d = signals.filter(F.col("signal_type").isin(list(types))) if types else signals
    hour = d.groupBy("company_id", F.date_trunc("hour", F.col("event_date").cast("timestamp")).cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    s = hour.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.col("h") - F.make_dt_interval(F.lit(0), i))))
    g = s.groupBy("company_id", "start").agg(F.sum("n").alias("signals"))
    return g.withColumn("end", F.col("start") + F.expr("INTERVAL 24 HOURS")).select("company_id", "start", "end", "signals")


def rescore_triggers(events: DataFrame, key: str = "company_id", ts: str = "ts", tie: str = "event_id", need: int = 3, cooldown_hours: int = 1) -> DataFrame:
    """I4 batch twin: events that trigger a rescore.

    After a trigger at position p and time t the next one is the first event at
    position >= p + need with time >= t + cooldown.  That target is one number
    per event, so the chain is followed by pointer doubling.
    """
    c = cut(count_before(events, [key], ts, tie, F.expr(f"INTERVAL {cooldown_hours} HOURS"), "pos", "_early"))
    total = c.groupBy(key).agg(F.max("pos").alias("_n"))
    jump = c.withColumn("next", F.greatest(F.col("pos") + need, F.col("_early") + 1)).join(total, key)
    jump = jump.withColumn("next", F.when(F.col("next") <= F.col("_n"), F.col("next")))
    hops = jump.filter("next IS NOT NULL")
    first = jump.filter(F.col("pos") == need).select(key, "pos")
    chain = reachable(hops, [key], need).unionByName(first).distinct()
    return jump.select(key, tie, "pos").join(chain, [key, "pos"]).select(key, tie, F.col("pos").alias("position"))


def rescore_stream(events: DataFrame, key: str = "company_id", ts: str = "ts", tie: str = "event_id", need: int = 3, cooldown_hours: int = 1) -> DataFrame:
    """I4 on a stream that arrives in order, answered at once: per-key state is (count, last trigger), and only rows of one
    batch are put in event order.  For streams out of order see ``ordered.rescore``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap = cooldown_hours * 3_600_000_000

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values(["_us", tie])
        out = []
        for us, ident in zip(rows["_us"], rows[tie]):
            count += 1
            if count >= need and (last < 0 or us - last >= gap):
                out.append(int(ident))
                count, last = 0, int(us)
        state.update((count, last))
        yield pd.DataFrame({key: [k[0]] * len(out), tie: out})

    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    d = events.select(key, tie, us.alias("_us"))
    return d.groupBy(key).applyInPandasWithState(step, f"{key} bigint, {tie} bigint", "count long, last long", "append", GroupStateTimeout.NoTimeout)


def watchlist_state(scores: DataFrame, add: float = 70.0, remove: float = 50.0, key: str = "company_id", order: str = "score_date") -> DataFrame:
    """Action, membership, entry score and peak after every score (one row per key and day).

    Membership after a row is set by the last score that reached ``add`` or fell
    below ``remove``; an entry's score and peak restart at each re-entry.
    """
    w = W.partitionBy(key).orderBy(order)
    mark = F.when(F.col("score") >= add, F.lit(True)).when(F.col("score") < remove, F.lit(False))
    d = scores.withColumn("member", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))
    d = d.withColumn("_was", F.coalesce(F.lag("member").over(w), F.lit(False)))
    action = F.when(~F.col("_was") & F.col("member"), "added").when(F.col("_was") & ~F.col("member"), "removed").when(F.col("_was"), "updated")
    d = d.withColumn("action", action).withColumn("_ep", F.sum(F.when(F.col("action") == "added", 1).otherwise(0)).over(w))
    e = W.partitionBy(key, "_ep").orderBy(order)
    inside = F.col("member")
    return (d.withColumn("add_score", F.when(inside, F.first("score").over(e))).withColumn("peak_score", F.when(inside, F.max("score").over(e)))
            .drop("_was", "_ep"))


def dead_letters(messages: DataFrame, col: str = "body", schema: str = ENVELOPE) -> DataFrame:
    """Malformed messages are rejected, failures retry up to the limit, then dead-letter."""
    ok = F.from_json(F.col(col), schema)
    d = messages.withColumn("malformed", F.col(col).isNull() | ok.isNull() | ok.getField("event_id").isNull())
    return d.withColumn("outcome", F.when(F.col("malformed"), "rejected").when(F.col("error_type").isNull(), "processed")
                        .when(F.col("attempts") >= MAX_RETRIES, "dead_letter").otherwise("retry"))


def replayable(dead: DataFrame, as_of, max_hours: int = 24) -> DataFrame:
    """Dead letters with a transient error that are younger than a day."""
    age = micros_between(F.col("first_failure"), at(as_of)) / 3_600_000_000
    return dead.filter((F.col("outcome") == "dead_letter") & F.col("error_type").isin(RETRIABLE) & (age < max_hours))


def idempotent_stream(events: DataFrame, ts: str = "ts", key: str = "event_id", delay: str = "24 hours") -> DataFrame:
    """I10 on a stream: repeats of an id inside the watermark are dropped."""
    return watermarked(events, ts, delay).dropDuplicatesWithinWatermark([key])


def late_and_out_of_order(events: DataFrame, key: str = "company_id", seq: str = "seq", ts: str = "ts", arrival: str = "arrival", delay: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Per company in arrival order, rows behind the highest sequence or older than the delay."""
    d = running_max(sliced(events, [key], [arrival, seq]), [key], F.col("_slice"), [arrival, seq], {"_seq": seq, "_ts": ts}).drop("_slice")
    z = lambda c: F.coalesce(c, F.lit(False))
    return (d.withColumn("out_of_order", z(F.col(seq) < F.col("_seq"))).withColumn("late", z(F.col(ts) < F.col("_ts") - F.expr(delay))).drop("_seq", "_ts"))


def alert_dedup(alerts: DataFrame, key: str = "company_id", kind: str = "alert", ts: str = "ts", tie: str = "alert_id",
                daily: Sequence[str] = ("score_update",), hours: int = 24) -> DataFrame:
    """An alert is sent when none of its company and kind was sent in the last ``hours``; kinds in ``daily`` once a
    day.  One row per company and day combines what was sent and counts what was not."""
    d = alerts.withColumn("day", F.col(ts).cast("date"))
    often = F.col(kind).isin(list(daily))
    first = d.filter(often).groupBy(key, kind, "day").agg(F.min_by(tie, F.struct(ts, tie)).alias(tie)).select(tie)
    sent = first_per_ttl(d.filter(~F.coalesce(often, F.lit(False))).select(key, kind, ts, tie), [key, kind], ts, tie, hours / 24).select(tie).unionByName(first)
    d = d.join(sent.withColumn("_sent", F.lit(True)), tie, "left")
    return d.groupBy(key, "day").agg(F.array_sort(F.collect_set(F.when(F.col("_sent"), F.col(kind)))).alias("alerts"),
                                     F.min(F.when(F.col("_sent"), F.col(ts))).alias("first_at"), F.count_if(F.col("_sent").isNull()).alias("suppressed"))


def alert_levels(changes: DataFrame) -> DataFrame:
    """Level from the change per horizon and the score (change_7d, change_14d, change_30d, positive_signals, best_match)."""
    s, c7, c14, c30 = F.col("score"), F.coalesce("change_7d", F.lit(0.0)), F.coalesce("change_14d", F.lit(0.0)), F.coalesce("change_30d", F.lit(0.0))
    best = F.greatest(c7, c14, c30)
    level = first_match([
        ((c7 >= 15) | (s >= 85) | ((best >= 10) & (s >= 75)), "CRITICAL"),
        ((F.greatest(c7, c14) >= 10) | (s >= 75) | ((best >= 8) & (F.col("positive_signals") > 1)), "HIGH"),
        ((best >= 5) | (s >= 65) | (F.col("best_match") >= 80), "MEDIUM"), ((best >= 3) | (s >= 55), "LOW")], "NONE")
    return changes.withColumn("level", level)


def insider_cluster(buys: DataFrame, as_of, days: int = 30, people: int = 3) -> DataFrame:
    """Companies with at least ``people`` distinct insider buyers in the window."""
    d = buys.filter(F.col("ts") >= at(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return d.groupBy("company_id").agg(F.count_distinct("actor").alias("actors")).filter(F.col("actors") >= people)


def activity_sessions(events: DataFrame, key: str, ts: str, tie: str, gap: str = "INTERVAL 90 DAYS") -> DataFrame:
    """Bursts separated by more than the gap, from bucketed lag and running sum."""
    d = previous_values(sliced(events.select(key, ts, tie), [key], [ts, tie]), [key], F.col("_slice"), [ts, tie], {"_prev": ts})
    new = F.when(F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + F.expr(gap)), 1).otherwise(0)
    d = running_sum(cut(d.select(key, ts, tie, "_slice", new.alias("_new"))), [key], F.col("_slice"), [ts, tie], F.col("_new"), "session_no")
    return d.groupBy(key, "session_no").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("events"))


def activity_sessions_stream(events: DataFrame, key: str, ts: str, gap: str = "90 days", watermark: str = "1 day") -> DataFrame:
    """I14 on a stream."""
    return (watermarked(events, ts, watermark).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"))


def source_rates(events: DataFrame, as_of, source: str = "source", ts: str = "ts", hours: int = 1) -> DataFrame:
    """Events of the last hour per source, banded; silent sources are low."""
    recent = F.col(ts) >= at(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    g = events.groupBy(source).agg(F.count_if(recent).alias("events"))
    return g.withColumn("band", F.when(F.col("events") > 100, "high").when(F.col("events") < 10, "low").otherwise("normal"))


def source_metrics(events: DataFrame, source: str = "source", latency: str = "latency_ms", tie: str = "event_id") -> DataFrame:
    """I16: counts, errors, mean quality and exact latency percentiles per source."""
    g = events.groupBy(source).agg(F.count_if("is_error").alias("errors"), F.avg("quality").alias("quality"))
    q = exact_quantiles(events, [source], latency, tie, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return g.join(q.withColumnRenamed("n", "events"), source)


def watchlist_tiers(rows: DataFrame) -> DataFrame:
    """Entry rule, special conditions and tiers 1-4."""
    c = F.col
    s, run = c("score"), c("runway_months")
    special = (((s >= 55) & (run < 12) & c("phase3_soon")) | ((s >= 50) & c("strategic_review")) | ((s >= 55) & c("activist"))
               | ((s >= 50) & (c("strong_matches") >= 3)) | c("advisor_hired"))
    standard = (s >= 60) & (c("lead_rank") >= 2) & c("market_cap").between(1e8, 1e10) & (c("confidence") >= 0.7)
    d = rows.withColumn("special", F.coalesce(special, F.lit(False))).withColumn("entry", F.coalesce(standard, F.lit(False)) | F.coalesce(special, F.lit(False)))
    sure = c("confidence") >= 0.7
    tier = first_match([
        (((s >= 80) & sure) | ((s >= 70) & c("strategic_review")) | ((s >= 65) & c("advisor_hired")), 1),
        (((s >= 70) & sure) | ((s >= 60) & sure & (run < 9)) | ((s >= 60) & sure & (c("matches_80") >= 2)), 2),
        (((s >= 60) & sure) | ((s >= 55) & c("special")), 3), (((s >= 50) & c("special")) | ((s >= 60) & ~sure), 4)], None)
    return d.withColumn("tier", tier)


def watchlist_stream(scores: DataFrame, add: float = 70.0, remove: float = 50.0, key: str = "company_id", ts: str = "ts") -> DataFrame:
    """I6 on a stream that arrives in order, answered at once: per-key state is (member, entry score, peak), and only rows of
    one batch are put in time order.  For streams out of order see ``ordered.watchlist``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        member, entry, peak = state.get if state.exists else (False, 0.0, 0.0)
        out = []
        for us, s in pd.concat(list(frames)).sort_values("_us")[["_us", "score"]].itertuples(index=False):
            if not member and s >= add:
                member, entry, peak, action = True, s, s, "added"
            elif member and s < remove:
                member, action = False, "removed"
            elif member:
                peak, action = max(peak, s), "updated"
            else:
                continue
            out.append((k[0], int(us), action, s, entry if member else None, peak if member else None))
        state.update((bool(member), float(entry), float(peak)))
        yield pd.DataFrame(out, columns=[key, "us", "action", "score", "add_score", "peak_score"])

    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    d = scores.select(key, us.alias("_us"), F.col("score").cast("double").alias("score"))
    return d.groupBy(key).applyInPandasWithState(step, f"{key} bigint, us bigint, action string, score double, add_score double, peak_score double",
                                                 "member boolean, entry double, peak double", "append", GroupStateTimeout.NoTimeout)


def price_rollup_stream(ticks: DataFrame, ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """D32 on a stream: daily bars, final once the watermark passes the day."""
    order = F.struct(ts, "tick_id")
    return (watermarked(ticks, ts, delay).groupBy("symbol", F.window(ts, "1 day"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.avg("price").alias("vwap"))
            .select("symbol", F.col("window.start").cast("date").alias("day"), "open", "high", "low", "close", "volume", "vwap"))
