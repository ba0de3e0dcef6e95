"""Keyed operators that take the rows of a stream in event order, whatever order they arrive in.

Each row waits in its key's map state, under its millisecond, for a timer of that millisecond.  A timer fires once the
watermark has passed it, and Spark fires a key's timers in order, so a key's rows are met one millisecond after another;
no key's rows are ever sorted or held together.  The answer is that of the batch twin on all rows that were not behind the
watermark; those are for ``late_rows``.

What a key remembers is dropped by a timer of its own once no later row can depend on it.  State needs the RocksDB
provider, which keeps large state outside the heap (``state_on_disk``).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000  # microseconds
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_on_disk(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Calls ``step(state, row) -> (state, output rows)`` on a key's rows in order of ``_us``, then of ``tie``.

    ``state`` is a tuple or None; ``until(state)`` says at which microsecond it may be forgotten, None for not yet.
    """

    def __init__(self, step: Callable, until: Callable, state: T.StructType, row: T.StructType, tie: str, out: T.StructType) -> None:
        self.step, self.until, self.state, self.row, self.tie, self.out = step, until, state, row, tie, Row(*out.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ms long", T.StructType([T.StructField("rows", T.ArrayType(self.row))]))
        self.known = handle.getValueState("known", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.row.names
        for r in rows:
            ms = r["_us"] // 1000
            new = tuple(r[c] for c in names)
            if self.held.containsKey((ms,)):
                self.held.updateValue((ms,), ([*map(tuple, self.held.getValue((ms,))[0]), new],))
            else:
                self.held.updateValue((ms,), ([new],))
                self.handle.registerTimer(ms + 1)  # rows of this millisecond are behind the watermark from then on
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = tuple(self.known.get()) if self.known.exists() else None
        before = state
        if self.held.containsKey((now - 1,)):
            rows = [dict(zip(self.row.names, r)) for r in self.held.getValue((now - 1,))[0]]
            self.held.removeKey((now - 1,))
            for r in sorted(rows, key=lambda r: (r["_us"], r[self.tie])):
                state, out = self.step(state, r)
                for values in out:
                    yield self.out(*key, *values)
        end = None if state is None else self.until(state)
        if state is None or end is not None and end <= now * 1000:
            if before is not None:
                self.known.clear()
        elif state != before:
            self.known.update(state)
            if end is not None:
                self.handle.registerTimer(-(-end // 1000))

    def close(self) -> None:
        pass


def in_event_order(events: DataFrame, key: str, ts: str, tie: str, columns: Sequence[str], step: Callable, until: Callable,
                   state: str, out: str, delay: str) -> DataFrame:
    """``step`` over the rows (``_us``, ``tie`` and ``columns``) of each key in event order; ``delay`` is how late rows may come."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rows = rows.where(F.col(ts).isNotNull()).select(key, ts, F.unix_micros(ts).alias("_us"), *dict.fromkeys([tie, *columns]))
    held = T.StructType([rows.schema[c] for c in dict.fromkeys(["_us", tie, *columns])])
    form = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(out).fields])
    processor = InOrder(step, until, T.StructType.fromDDL(state), held, tie, form)
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=form, outputMode="Append", timeMode="EventTime")


def rescore(events: DataFrame, key: str = "company_id", ts: str = "ts", tie: str = "event_id", need: int = 3, cooldown_hours: int = 1, delay: str = "1 hour") -> DataFrame:
    """I4: an event triggers at ``need`` counted ones and a cooldown after the last trigger; counting goes on meanwhile.

    A key is forgotten when its cooldown is over and nothing has been counted since.
    """
    gap = cooldown_hours * HOUR

    def step(state, row):
        count, last = state or (0, None)
        if count + 1 >= need and (last is None or row["_us"] - last >= gap):
            return (0, row["_us"]), [(row[tie],)]
        return (count + 1, last), []

    def until(state):
        return state[1] + gap if state[0] == 0 else None

    return in_event_order(events, key, ts, tie, [], step, until, "count long, last long", f"{tie} {_kind(events, tie)}", delay)


def watchlist(scores: DataFrame, add: float = 70.0, remove: float = 50.0, key: str = "company_id", ts: str = "ts", tie: str = "score", delay: str = "1 hour") -> DataFrame:
    """Added at ``add``, removed below ``remove``, updated between.  Only members are remembered."""

    def step(state, row):
        s = row["score"]
        if s is None:
            return state, []
        if state is None:
            return ((s, s), [(row["_us"], "added", s, s, s)]) if s >= add else (None, [])
        if s < remove:
            return None, [(row["_us"], "removed", s, None, None)]
        peak = max(state[1], s)
        return (state[0], peak), [(row["_us"], "updated", s, state[0], peak)]

    scores = scores.withColumn("score", F.col("score").cast("double"))
    return in_event_order(scores, key, ts, tie, ["score"], step, lambda state: None, "entry double, peak double",
                          "us long, action string, score double, add_score double, peak_score double", delay)


def dedup_alerts(alerts: DataFrame, key: str = "company_id", kind: str = "alert", ts: str = "ts", tie: str = "alert_id",
                 daily: Sequence[str] = ("score_update",), hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """An alert is sent if none of its company and kind was sent in the last ``hours``; kinds in ``daily`` once a day.

    A company is remembered by the times of what was sent, and a kind until those hours, or the day, are over.
    """
    gap, day = hours * HOUR, 24 * HOUR

    def end(name, sent):
        return (sent // day + 1) * day if name in daily else sent + gap

    def step(state, row):
        live = {k: us for k, us in (state[0] if state else {}).items() if end(k, us) > row["_us"]}
        name = row[kind] if row[kind] is not None else ""
        sent = name not in live
        if sent:
            live[name] = row["_us"]
        return (live,), [(row[tie], row[kind], row["_us"], sent)]

    def until(state):
        return max(end(k, us) for k, us in state[0].items())

    return in_event_order(alerts, key, ts, tie, [kind], step, until, "sent map<string,long>",
                          f"{tie} {_kind(alerts, tie)}, {kind} string, us long, sent boolean", delay)


def arrivals(events: DataFrame, key: str = "company_id", seq: str = "seq", ts: str = "ts", arrival: str = "arrival", delay_us: int = HOUR,
             delay: str = "1 hour", idle_hours: int | None = None) -> DataFrame:
    """Every event, in order of arrival, with ``out_of_order`` (behind the highest sequence number of its key) and ``late``
    (its time more than ``delay_us`` behind the latest one).

    A key keeps its two maxima; with ``idle_hours`` they are dropped after so long without an arrival.
    """
    def step(state, row):
        top, latest, _ = state or (None, None, None)
        s, t = row[seq], row["_ts"]
        behind = s is not None and top is not None and s < top
        late = t is not None and latest is not None and t < latest - delay_us
        new = (s if top is None else top if s is None else max(s, top), t if latest is None else latest if t is None else max(t, latest), row["_us"])
        return new, [(s, t, row["_us"], behind, late)]

    def until(state):
        return None if idle_hours is None else state[2] + idle_hours * HOUR

    rows = events.withColumn("_ts", F.unix_micros(F.col(ts).cast("timestamp")))
    return in_event_order(rows, key, arrival, seq, ["_ts"], step, until, "top long, latest long, seen long",
                          f"{seq} {_kind(events, seq)}, ts_us long, arrival_us long, out_of_order boolean, late boolean", delay)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sinks(stream: DataFrame, folders: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]], checkpoint: str):
    """One stream into several tables: ``name -> (folder, rows of it)``.

    Every table takes a batch into a folder named by the batch; a batch that is run again after a failure between two sinks
    writes the same folders again, so nothing is lost and nothing is there twice.
    """
    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for folder, rows in folders.values():
                rows(held).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str):
    """The on-time rows of ``arrivals`` into one table, the late ones into a side table; together they are the input."""
    return sinks(stream, {"on_time": (on_time, lambda d: d.where("NOT late")), "late": (late, lambda d: d.where("late"))}, checkpoint)
