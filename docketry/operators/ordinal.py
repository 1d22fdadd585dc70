"""Row numbers in a declared order."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.store import materialise

# Where a row came from, in row order; the file readers add these.
ORIGIN = ("_part_no", "_file", "_block", "_line")


def sorted_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows in ranges of the whole sort key, with the range and a generated id inside it.

    Neither a single task nor one heavy first key sees all rows. Write the result before it is
    numbered: generated ids must not change between two reads.
    """
    return df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_generated")
    )


def origin_offsets(rows: DataFrame, origin: Sequence[str], line: str) -> DataFrame:
    """Per origin, in order: its lowest line and the number of rows before it.

    Sums in two levels: the origins, one per sorted range or file split, are put into about as many
    ranges as each range then has origins. Running sums are taken within each range, and the
    ranges' totals are summed up in one row.
    """
    splits = rows.groupBy(*origin).agg(F.min(line).alias("_low"), F.count(F.lit(1)).alias("_rows"))
    splits = materialise(splits, "origins")
    ranges = isqrt(splits.count()) + 1
    splits = splits.repartitionByRange(ranges, *origin).withColumn("_part", F.spark_partition_id())
    ranged = materialise(splits, "origin_ranges")

    totals = ranged.groupBy("_part").agg(F.sum("_rows").alias("n"))
    totals = totals.agg(F.array_sort(F.collect_list(F.struct("_part", "n"))).alias("t"))
    before = lambda t, i: F.struct(
        t["_part"].alias("_part"),
        F.aggregate(F.slice("t", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("_earlier"),
    )
    earlier = totals.select(F.inline(F.transform("t", before)))
    within = W.partitionBy("_part").orderBy(*origin).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in_part", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
        .join(earlier, "_part")
        .withColumn("_before", F.col("_earlier") + F.col("_in_part"))
        .drop("_rows", "_part", "_in_part", "_earlier")
    )


def with_row_numbers(
    rows: DataFrame, offsets: DataFrame, origin: Sequence[str], line: str, text_id: str = "unique_id"
) -> DataFrame:
    """Add each row's number, from 1, and its zero-padded text: its origin's offset and its line in it.

    The lines of one origin must be consecutive numbers.
    """
    number = F.col("_before") + F.col(line) - F.col("_low") + 1
    return (
        rows.join(offsets, list(origin))
        .withColumn("row_number", number)
        .withColumn(text_id, F.format_string("%06d", "row_number"))
        .drop("_low", "_before", *origin, line)
    )
