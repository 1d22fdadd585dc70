"""Roll-ups from charge rows to persons and cases.

All of them are grouped aggregates with map-side partial results, so a person or case that
holds a large part of the rows shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.exprs import ratio, share


def entity_rollup(df: DataFrame, *keys: str, **measures: Column) -> DataFrame:
    """One row per entity: its number of rows and the given aggregates."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_charges"), *[m.alias(name) for name, m in measures.items()]
    )


def entity_count_and_share(
    rollup: DataFrame, condition: Column, count: str = "persons", name: str = "share"
) -> DataFrame:
    """Number and share of entities for which the condition holds; missing is not a hit."""
    return rollup.agg(F.count_if(condition).alias(count), share(condition).alias(name))


def share_within_entity(
    df: DataFrame, *keys: str, hit: Column, member: Column | None = None, name: str = "share"
) -> DataFrame:
    """Share of an entity's rows that are hits, for entities with at least one member row.

    Finding the members and measuring their share is one pass: the count of member rows takes
    the place of a semi-join back to the same rows.
    """
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(hit).alias("_hits"),
            F.count(F.lit(1)).alias("_rows"),
            F.count_if(hit if member is None else member).alias("_members"),
        )
        .filter("_members > 0")
        .select(*keys, ratio(F.col("_hits"), F.col("_rows")).alias(name))
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: str, *values: str) -> DataFrame:
    """The given values of each group's first row in `order`."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*values), F.col(order)).alias("_first"))
        .select(*keys, "_first.*")
    )


def ordered_distinct_text(df: DataFrame, value: str, order: str, sep: str) -> DataFrame:
    """One row: the distinct values in order of first appearance, joined to one text.

    Rows are reduced to distinct values, these are dealt out in ranges of their first appearance,
    and each range is joined to a segment by itself. Only the segments meet in one row, which is
    the result.
    """
    firsts = df.groupBy(value).agg(F.min(order).alias("_first"))
    ranged = firsts.repartitionByRange("_first").withColumn("_part", F.spark_partition_id())
    in_order = lambda at, text: F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda p: p["_text"])
    text = F.coalesce(value, F.lit("NA")).alias("_text")
    segments = ranged.groupBy("_part").agg(F.array_join(in_order("_first", text), sep).alias("_text"))
    return segments.agg(F.array_join(in_order("_part", F.col("_text")), sep).alias(value))
