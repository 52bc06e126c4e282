"""A cleaning pipeline over ``documents``: toxic documents go, one of each group of near copies stays, repeated strings are
cut out, contaminated documents go, and what is left is packed into training sequences.

Every stage works on all that the one before it kept and behaves on nulls, empty texts, repeated rows and empty tables as its
operator says.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlspark.llm import decontamination, jaccard_join, packing, substrings, toxicity
from ddlspark.llm._work import materialize

#: Strings of so many bytes that occur elsewhere go: op7's 400 leave most passages of just over 50 words, of some 300 bytes.
REPEAT_BYTES = 200
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the fold that op3 holds out trains nothing here either."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.fold(F.col("doc_id"), 5) == 0)
    return toxicity.score_documents(docs.select(*COLUMNS), model).filter("toxicity.score < 0.5").drop("toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard links of 0.75 connect."""
    return jaccard_join.without_similar(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of REPEAT_BYTES that occur elsewhere; a character of which bytes were removed goes whole."""
    kept = substrings.without_repeats(docs.select(*COLUMNS), REPEAT_BYTES)
    whole = F.col("dedup.n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(readable(F.col("dedup.kept")))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return kept.withColumns({"n_chars": n_chars, "text": text}).select(*COLUMNS)


def readable(kept: Column) -> Column:
    """Bytes as text, without incomplete characters."""

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: b.decode("utf-8", "ignore") if b is not None else None)

    return decoded(kept)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs.select(*COLUMNS), items).filter("not contamination.contaminated").drop("contamination")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents by sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL expresses neither the fitted chain nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
