"""The registered queries of the training-text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import encode_texts
from docketry.llm.embeddings import link_vectors
from docketry.llm.licenses import scan_licenses
from docketry.llm.maxent import score_texts
from docketry.llm.minhash import near_duplicates
from docketry.llm.mixing import mix
from docketry.llm.oracle import ORACLE_SQL
from docketry.llm.phrases import remove_repeated_passages
from docketry.llm.pivots import scaled_down, top_products
from docketry.llm.quality import judge
from docketry.llm.squares import find_runs
from docketry.llm.suffixes import remove_repeated_bytes
from docketry.llm.urls import judge_urls
from docketry.llm.ztrie import gather_turns, prefix_nodes
from docketry.store import finished

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["ORACLE_SQL", "QUERIES"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs).select(
        "rest.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "kept_text"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept_text"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "rest.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "rest.doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(spelled.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "row.source", "rank", "block", "slot")


# The rules the pages are judged by.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(pa.table(dict(zip(("host", "path", "verdict"), map(list, zip(*URL_RULES))))))
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op10_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def plant_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts for run detection: every tenth document, by the crc32 of its id, turns periodic.

    With g the tenth of the crc32, each word from number g % n on is replaced by a word of the
    period that begins there. A null doc_id has no crc32, its text stays as it is.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumns({"_h": h, "_words": F.when(h % 10 == 0, words)})
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    rows = rows.withColumns({"_n": n, "_a": F.when(n > 0, (g % n).cast("int"))})
    period = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)).cast("int")
    rows = rows.withColumn("_p", period)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    planted = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get(F.col("_words"), place(i)))
    text = F.when(F.col("_n") > 0, F.array_join(planted, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plant_periods(read(spark, sf_dir, "documents").select("doc_id", "text"))
    higher = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), lambda a, b: F.when(higher(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = find_runs(docs).withColumn("best", best)
    return found.select(
        "rest.doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", scaled_down(F.col("embedding"), 256).alias("whole"))
    return top_products(vectors, "vec_id", "whole", F.col("vec_id") % 50 == 0, k=5)


def splice_openings(gathered: DataFrame) -> DataFrame:
    """The contract's rebuilt conversations: c opens with the first turns of conversation c - c % 5.

    There are crc32(c) % 9 of them, or all if that has fewer, none if it is absent; c's own turns
    after its first so many follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = gathered.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("from_id"))
    lent = gathered.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("from_id"), F.slice("turns", 1, 8).alias("lent"))
    none = F.slice("turns", 1, 0)
    opening = F.when(F.col("h") > 0, F.slice(F.coalesce("lent", none), 1, F.col("h"))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(lent, "from_id", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(splice_openings(gather_turns(read(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def _leaving_its_result(query: Query) -> Query:
    """The query, with its result written if it wrote tables on the way, which then go."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(spark, query.__name__, lambda: query(spark, sf_dir))

    return run


QUERIES: dict[str, Query] = {
    q.__name__: _leaving_its_result(q)
    for q in (
        op1_embedding_near_dedup,
        op2_substring_dedup,
        op3_suffix_dedup,
        op4_quality_rules,
        op5_byte_bpe,
        op6_source_mix,
        op7_url_filter,
        op8_license_scan,
        op9_minhash_near_dedup,
        op10_maxent_score,
        op11_periodic_runs,
        op12_exact_top_k,
        op13_conversation_trie,
    )
}
QUERIES["pipeline"] = pipeline
