"""A training-data pipeline of five corpus operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept: toxic documents go, one
document of each near-duplicate group stays, benchmark passages are cut out, personal data gets pseudonyms, and the
texts are encoded.  All stages but the last return the columns of ``documents``; ``run`` writes each
stage's result into the shared checkpoint folder before the next.

Texts go to Python a thousand at a time: a batch of Spark's usual size holds tens of megabytes of them, in the JVM
and in every worker.

Rows with null ids or texts go through every stage; empty tables give empty results.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.llm.common import materialise, read_table
from packspark.llm.decontaminate import decontaminate
from packspark.llm.jaccard import one_per_group
from packspark.llm.pieces import digest
from packspark.llm.pii import KINDS, pseudonymise
from packspark.llm.queries import PIECE_MODEL, vocabulary
from packspark.llm.toxicity import fit, score


BATCH_ROWS = "1000"


def small_batches(stage):
    """The stage with Arrow batches of BATCH_ROWS rows (a session setting, also for its later evaluation)."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 0").select(*docs.columns)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the smallest id."""
    return one_per_group(docs)


@small_batches
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; mostly contaminated ones go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@small_batches
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows a changed text."""
    out = pseudonymise(docs)
    changed = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)) > 0
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[size.alias(c) if c == "n_chars" else c for c in docs.columns])


@small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, their count, and digests of ids and decoded text."""
    return digest(docs, vocabulary(PIECE_MODEL), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
