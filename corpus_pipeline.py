"""Training-corpus pipeline: quality rules, near-duplicates, personal data, source mixing, packing.

Each stage takes what the one before kept, written as Parquet and read again; all but the last return the columns of
documents.  Between stages ``run`` writes into the shared folder that the session names for checkpoints.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealsight.functions.scale import checkpoint_folder, remove
from dealsight.llm import minhash, mixing, packing, pii, rules
from dealsight.llm.queries import packing_vocabulary, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return rules.keep(docs, rules.fit(docs, table(spark, folder, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace personal data in the texts by the names of its kinds."""
    return pii.redact(docs, pii.fit(docs))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeat the documents as the target weights of their sources ask; none is cut."""
    return mixing.materialise(mixing.whole_documents(mixing.mix(docs)))


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack the tokens of every document into sequences."""
    return packing.pack(docs, packing_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("minhash_near_dedup", near_duplicates), ("personal_data", personal_data),
    ("source_mixing", source_mix), ("best_fit_packing", sequences),
]
#: No SQL form: the stages fit models and tokenize; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    out = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4()}"
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, folder)
        if k + 1 == len(STAGES):
            return kept
        kept.write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if k:
            remove(spark, f"{out}/{STAGES[k - 1][0]}")
