"""Registered queries of the corpus operators and their DuckDB twins (where SQL can express one)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.llm.centroids import cluster, clustering_sql
from packspark.llm.chat import format_windows, read_back
from packspark.llm.common import read_table, text_of
from packspark.llm.decontaminate import contamination_sql, n_hit, scan
from packspark.llm.jaccard import jaccard_components
from packspark.llm.lattice import score_texts
from packspark.llm.pieces import digest
from packspark.llm.pii import pseudonymise
from packspark.llm.quality import MEASURES, quality, quality_sql
from packspark.llm.resample import resample
from packspark.llm.secrets import KINDS, count_kind, scan_secrets, span_text
from packspark.llm.sharding import shard_rows
from packspark.llm.tokens import section_tokens
from packspark.llm.toxicity import fit, held_out, score

PIECE_MODEL = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 16
SHARD_KEY = "corpus-shuffle-1"


def vocabulary(name: str) -> bytes:
    """A public vocabulary file, read on the driver (each is under two megabytes) and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    t = text_of(docs)
    rows = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
                       F.xxhash64(t).alias("text_hash"))
    placed = shard_rows(rows, ["doc_id", "size", "text_crc32", "text_hash"], SHARDS, SHARD_KEY)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(PIECE_MODEL))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return section_tokens(docs, vocabulary(RANKS), split_pattern())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("secrets")).alias("spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_windows(turns, vocabulary(RANKS), split_pattern()))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    scored = score_texts(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), vocabulary(PIECE_MODEL), fold != 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"),
                     columns=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op1_quality_rules": quality_sql,
    "op3_decontamination": contamination_sql,
    "op12_centroid_clustering": clustering_sql,
}
