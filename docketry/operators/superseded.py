"""Removal of interim records once a later record of the same charge exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.rollup import first_per_group
from docketry.store import materialise

ROWS_PER_SALT = 100_000
MOST_HEAVY = 1000


def superseded_keys(df: DataFrame, key: str, interim: Column) -> DataFrame:
    """Keys with an interim row and more than one row, with the number of their interim rows.

    `all_interim` tells if nothing else is there. A count per key has partial counts on the map
    side, so a key with very many rows is no heavier than others. Write the result before it is
    joined.
    """
    return (
        df.select(key, F.coalesce(interim, F.lit(False)).alias("_is_interim"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_is_interim").alias("interim_rows"))
        .filter("interim_rows > 0 and _rows > 1")
        .select(key, "interim_rows", (F.col("interim_rows") == F.col("_rows")).alias("all_interim"))
    )


def salted(
    rows: DataFrame, keys: DataFrame, key: str, order: str, rows_per_salt: int = ROWS_PER_SALT
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (key, `_salt`) that meets no heavy key: rows dealt out, their key repeated.

    A key with more than `rows_per_salt` of the rows gets as many salts as it needs, every other
    key one. Heavy keys have a share of the rows each, so there are fewer than `MOST_HEAVY` of
    them whatever the data, and they alone are broadcast; the join itself need not be split at
    run time. `keys` is a written table with a count `interim_rows` per key.
    """
    total = keys.agg(F.sum("interim_rows")).first()[0] or 0
    share = max(rows_per_salt, -(-total // MOST_HEAVY))
    dealt = keys.withColumn("_salts", F.ceil(F.col("interim_rows") / share).cast("int"))
    heavy = dealt.filter("_salts > 1").select(key, "_salts")
    salt = F.pmod(F.xxhash64(order), F.coalesce("_salts", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    return rows, dealt.withColumn("_salt", each).drop("_salts")


def surviving_interim_rows(
    interim_rows: DataFrame,
    superseded: DataFrame,
    key: str,
    keep_one_if_all_superseded: bool = False,
    order: str = "row_order",
) -> DataFrame:
    """The interim rows that stay: those alone under their key.

    With `keep_one_if_all_superseded` a key that has interim rows only keeps its first one;
    without it, such rows all go.
    """
    rows, keys = salted(interim_rows, superseded, key, order)
    on, columns = [key, "_salt"], interim_rows.columns
    kept = rows.join(keys.select(*on), on, "left_anti").select(*columns)
    if keep_one_if_all_superseded:
        ties = rows.join(keys.filter("all_interim").select(*on), on, "left_semi")
        others = [c for c in columns if c != key]
        kept = kept.unionByName(first_per_group(ties, [key], order, *others))
    return kept


def drop_superseded(
    df: DataFrame,
    key: str,
    interim: Column,
    keep_one_if_all_superseded: bool = False,
    order: str = "row_order",
) -> DataFrame:
    """Drop interim rows whose key has another row. The key must not be missing.

    Rows that are not interim pass without a shuffle; the superseded keys are written. `df` is
    read more than once: hand over a table rather than a long plan.
    """
    interim = F.coalesce(interim, F.lit(False))
    keys = materialise(superseded_keys(df, key, interim), "superseded")
    kept = surviving_interim_rows(df.filter(interim), keys, key, keep_one_if_all_superseded, order)
    return df.filter(~interim).unionByName(kept)
