"""Frequency tables, percents and ranked listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.exprs import ratio


def with_percent(
    counts: DataFrame, within: Sequence[str] = (), count: str = "n", pct: str = "pct", scale: int = 100
) -> DataFrame:
    """Add each row's part of the total, or of the total of its `within` group.

    The totals come from the counts themselves, so Spark reuses their shuffle, and they are
    attached as a scalar or by a join: no window pulls a long table into one task.
    """
    if not within:
        total = counts.agg(F.sum(count)).scalar()
        return counts.withColumn(pct, ratio(F.col(count), total) * scale)
    marked = [f"_{g}" for g in within]
    totals = counts.groupBy(*[F.col(g).alias(m) for g, m in zip(within, marked)]).agg(
        F.sum(count).alias("_total")
    )
    same_group = [F.col(g).eqNullSafe(F.col(m)) for g, m in zip(within, marked)]
    return (
        counts.join(totals, same_group)
        .withColumn(pct, ratio(F.col(count), F.col("_total")) * scale)
        .drop("_total", *marked)
    )


def freq_table(
    df: DataFrame,
    *keys: str,
    within: Sequence[str] = (),
    count: str = "n",
    pct: str = "pct",
    sort: bool = True,
) -> DataFrame:
    """Count rows per key with percents, overall or inside the `within` groups.

    A missing key is a group of its own. Sorted from most to least frequent, ties by key.
    """
    groups = [*within, *keys]
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias(count))
    table = with_percent(counts, within, count, pct)
    return table.orderBy(*ranking(count, groups)) if sort else table


def ranking(measure: str, ties: Sequence[str]) -> list[Column]:
    """Sort columns: measure downwards, then the tie keys upwards with missing ones last."""
    return [F.desc_nulls_last(measure), *[F.asc_nulls_last(t) for t in ties]]


def top_k(table: DataFrame, k: int, measure: str, ties: Sequence[str]) -> DataFrame:
    """The k rows with the highest measure."""
    return table.orderBy(*ranking(measure, ties)).limit(k)


def rank_range(table: DataFrame, first: int, last: int, measure: str, ties: Sequence[str]) -> DataFrame:
    """Rows ranked from `first` to `last`, both counted from one."""
    return table.orderBy(*ranking(measure, ties)).offset(first - 1).limit(last - first + 1)


def top_k_of_top_m(
    table: DataFrame, k: int, by: str, m: int, among: str, ties: Sequence[str]
) -> DataFrame:
    """The k rows highest in one measure, out of the m rows highest in another."""
    return top_k(top_k(table, m, among, ties), k, by, ties)
