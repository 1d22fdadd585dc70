"""Offence texts: one text per key, and the join with its fallback."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.constants import HAND_ENTERED_OFFENCES
from docketry.functions.exprs import paste, recode


def code_table_keys(code_table: DataFrame) -> DataFrame:
    """Lower-case the texts and build the key CODE_SECTION_LEVEL of each code-table row."""
    return code_table.withColumn("offense_description", F.lower("offense_description")).withColumn(
        "key", paste("penal_code", F.replace("offense_number", F.lit(" "), F.lit("")), "m_f")
    )


def merge_texts(code_table: DataFrame, order: str = "row_order", sep: str = " and/or ") -> DataFrame:
    """One row per key: its texts in table order, joined, with the key at the end.

    Merged in two levels: the table is dealt out in ranges of key and order, so that a key with
    very many texts lies in as many ranges as it needs; each range joins its texts of a key, and
    the key joins its ranges' texts.
    """
    text = F.coalesce("offense_description", F.lit("NA")).alias("_text")
    rows = code_table.select("key", F.col(order).alias("_at"), text).repartitionByRange("key", "_at")
    in_order = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "_text"))), lambda p: p["_text"])
    segments = (
        rows.withColumn("_part", F.spark_partition_id())
        .groupBy("key", "_part")
        .agg(F.array_join(in_order("_at"), sep).alias("_text"))
    )
    merged = segments.groupBy("key").agg(F.array_join(in_order("_part"), sep).alias("offense_description"))
    return merged.withColumn("offense_description", paste("offense_description", "key", sep=" -- "))


def describe(
    df: DataFrame, texts: DataFrame, hand_entered: Mapping[str, str] = HAND_ENTERED_OFFENCES
) -> DataFrame:
    """Add the offence text by key; a key without one is its own text unless entered by hand."""
    joined = df.join(texts, "key", "left")
    text = recode(F.coalesce("offense_description", "key"), hand_entered)
    return joined.withColumn("offense_description", text)
