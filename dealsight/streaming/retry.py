"""I9 as a loop: a stream of messages into several sinks, with an attempts table that feeds the next batch.

A round reads the new messages and what the round before left to try again, calls the handler once, and writes four
tables: processed, rejected, dead and, last, attempts.  A round counts once its attempts are complete.  A batch that is run
again after a failure between two sinks writes the same folders again; what a round left that never completed is not read.
So every message is in exactly one table, however often a run is ended and started again.

Rounds of the stream are numbered by batch; ``drain`` and ``replay`` add rounds after the last one, so that retries and
replayed messages need no new message to arrive.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealsight.functions.clock import at, micros_between
from dealsight.functions.scale import cut
from dealsight.streaming.events import ENVELOPE, MAX_RETRIES, RETRIABLE

Handler = Callable[[DataFrame], DataFrame]
FORM = "message_id string, body string, attempts int, error_type string, first_failure timestamp_ntz"
TABLES = ("processed", "rejected", "dead", "attempts")


def rounds(spark: SparkSession, root: str) -> list[str]:
    """The complete rounds, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/attempts")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if fs.exists(done(p, "_SUCCESS")))


def rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table over all complete rounds, with their ``round``; of ``attempts`` those of the last one."""
    names = rounds(spark, root)
    if table == "attempts":
        names = names[-1:]
    if not names:
        return spark.createDataFrame([], f"{FORM}, round string")
    paths = [f"{root}/{table}/{n}" for n in names]
    return spark.read.schema(FORM).option("recursiveFileLookup", "true").parquet(*paths).withColumn("round", F.regexp_extract("_metadata.file_path", r"/(round=[0-9]+-[0-9]+)/", 1))


def _write(root: str, name: str, tables: dict[str, DataFrame]) -> None:
    for table in TABLES:  # attempts last: they complete the round
        tables[table].select(*[c.split()[0] for c in FORM.split(", ")]).write.mode("overwrite").parquet(f"{root}/{table}/{name}")


def _round(spark: SparkSession, root: str, name: str, todo: DataFrame, handler: Handler, now, limit: int) -> None:
    parsed = F.from_json("body", ENVELOPE)
    bad = F.col("body").isNull() | parsed.isNull() | parsed.getField("event_id").isNull()
    todo = cut(todo.withColumn("_bad", bad))  # the handler sees one fixed input, and is asked once
    done = cut(handler(todo.where("NOT _bad").drop("error_type")))
    failed = done.where(F.col("error_type").isNotNull()).withColumn("first_failure", F.coalesce("first_failure", at(now).cast("timestamp_ntz")))
    again = failed.where(F.col("attempts") < limit).withColumn("attempts", F.col("attempts") + 1)
    _write(root, name, {"processed": done.where(F.col("error_type").isNull()), "rejected": todo.where("_bad"),
                        "dead": failed.where(F.col("attempts") >= limit), "attempts": again})


def _before(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What the last complete round before ``name`` left to try again."""
    earlier = [n for n in rounds(spark, root) if n < name]
    return spark.read.schema(FORM).parquet(f"{root}/attempts/{earlier[-1]}") if earlier else spark.createDataFrame([], FORM)


def run(messages: DataFrame, handler: Handler, root: str, checkpoint: str, now, limit: int = MAX_RETRIES):
    """Start the loop on a stream of (message_id, body).  ``handler`` adds ``error_type``, null where a message is done;
    ``now`` gives the time of a batch (the first failure of what fails in it)."""

    def each(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"round={number:09d}-000"
        new = batch.select("message_id", "body", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error_type"),
                           F.lit(None).cast("timestamp_ntz").alias("first_failure"))
        _round(spark, root, name, new.unionByName(_before(spark, root, name)), handler, now(number), limit)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _next(names: list[str]) -> str:
    number, k = (names[-1] if names else "round=000000000-000")[6:].split("-")
    return f"round={number}-{int(k) + 1:03d}"


def drain(spark: SparkSession, handler: Handler, root: str, now, limit: int = MAX_RETRIES) -> None:
    """Further rounds on what is left to try again, until nothing is."""
    while names := rounds(spark, root):
        todo = rows(spark, root, "attempts").drop("round")
        if todo.isEmpty():
            return
        _round(spark, root, _next(names), todo, handler, now, limit)


def replay(spark: SparkSession, root: str, as_of, hours: int = 24) -> DataFrame:
    """Dead letters with a transient error younger than ``hours`` are tried anew; the others, returned, are failed for good.

    A dead letter is replayed once for each time it died: attempts of the replay's own round name it.
    """
    dead = rows(spark, root, "dead")
    age = micros_between(F.col("first_failure"), at(as_of)) / 3_600_000_000
    names = rounds(spark, root)
    seen = _replayed(spark, root)
    transient = F.col("error_type").isin(RETRIABLE) & (age < hours)
    again = cut(dead.where(transient).join(seen, ["message_id", "round"], "left_anti"))
    if not again.isEmpty():
        name = _next(names)
        again.select("message_id", "round").write.mode("overwrite").parquet(f"{root}/replayed/{name}")
        left = rows(spark, root, "attempts").drop("round")
        none = spark.createDataFrame([], FORM)
        fresh = again.drop("round").withColumn("attempts", F.lit(0)).withColumn("error_type", F.lit(None).cast("string"))
        _write(root, name, {"processed": none, "rejected": none, "dead": none, "attempts": left.unionByName(fresh)})
    return dead.where(~transient)


def _replayed(spark: SparkSession, root: str) -> DataFrame:
    """(message_id, round) of the dead letters that complete rounds have replayed."""
    form = "message_id string, round string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/replayed")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()
    paths = [f"{root}/replayed/{n}" for n in rounds(spark, root) if n in there]
    return spark.read.schema(form).option("recursiveFileLookup", "true").parquet(*paths) if paths else spark.createDataFrame([], form)
