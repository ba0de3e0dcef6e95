"""Session defaults for local runs, tests and the benchmark.

On a cluster the caller owns the session; nothing in the library needs these
settings beyond a checkpoint folder (see ``functions.scale.cut``).
"""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

from dealsight.functions.scale import checkpoint_folder


def local_session(cpus: str | int = "8", name: str = "dealsight") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DEALSIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_folder(spark)
    return spark
