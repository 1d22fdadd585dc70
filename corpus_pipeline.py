"""From raw documents to token ids: filter, near-dedup, passage removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; the runner writes it and hands the
next stage what it reads back. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import encode_texts
from docketry.llm.minhash import keep_one_of_each
from docketry.llm.mixing import mix
from docketry.llm.phrases import remove_repeated_passages
from docketry.llm.quality import judge
from docketry.store import finished, free

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source."""
    kept = judge(docs, with_text=True).filter("kept")
    return kept.select("rest.*", "text").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a smaller doc_id has; those left empty by it go.

    A text that loses nothing stays as it is, white space included; n_chars follows the text.
    """
    found = remove_repeated_passages(docs).filter("n_removed < n_words or n_words = 0")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    rows = found.select("rest.*", text.alias("text"), changed.alias("_changed"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("_changed"), F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: sorted ranges of it, file by file."""
    placed = mix(docs).select("slot", "rank", "row")
    return placed.orderBy("slot", "rank").select("row.*").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether the decoded ids give back the text."""
    encoded = encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select(
        "rest.doc_id", "rest.source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

# Signatures, automata and the rank queue have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again.

    What a stage writes on the way goes when its result is written, and that result when the next
    one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, finished(spark, name, lambda: stage(spark, docs, sf_dir), always=True)
        free(before)
    return docs
