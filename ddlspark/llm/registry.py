"""The query of each operator of this subpackage over its whole table, and the DuckDB SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontamination, jaccard_join, licenses, lm_scoring, substrings, token_files, toxicity, windows
from .packing import pack_documents

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    found = F.col("contamination")
    return out.select("doc_id", found.n_words.alias("n_words"), found.n_hit.alias("n_hit"), found.n_items.alias("n_items"), F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"), found.contaminated.alias("contaminated"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = toxicity.fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.tagged(F.col("text"), model).alias("tagged"))
    return scored.select("doc_id", "held_out", F.col("tagged.score").alias("score"), (F.col("tagged.score") >= 0.5).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m.template)))
    return found.select("doc_id", F.size(names).alias("n_licenses"), F.array_join(names, ",").alias("templates"))


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: each embedding is played as a tune, and a noisy clip of every fiftieth is looked for among all: one row a clip, with all its matches."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    known = vectors.select("id", audio.played(F.col("embedding")).alias("print"))
    clips = vectors.filter("id % 50 = 0").select("id", audio.played(F.col("embedding"), F.col("id")).alias("print"))
    return audio.aligned(clips, known, listed=True)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 7) == 2
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", toxicity.fold(F.col("doc_id"), 7) == 2)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_token_ids, op3_toxicity, op4_best_fit_packing, op5_ngram_jaccard_join, op6_substring_dedup, op7_suffix_array_dedup, op8_license_scans, op9_audio_fingerprints, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {}
