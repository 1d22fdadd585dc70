"""A bitmap of keys, of fixed size, that tells which rows need not be moved for a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.store import materialise

# 8 MB however many keys there are; with very many, more rows pass than need to, never fewer.
BITS = 1 << 26


def _bit(key: list[str]):
    return F.pmod(F.xxhash64(*key), F.lit(BITS)) + 1


def split(rows: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among `keys`, and those whose key is surely not.

    The bitmap has one bit for a hash of the key, in pieces of 4 KB. They are written and sent to
    every task: `BITS` bounds their size.
    """
    bits = keys.select(_bit(key).alias("_bit"))
    pieces = bits.groupBy(F.bitmap_bucket_number("_bit").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")
    )
    pieces = F.broadcast(materialise(pieces, "sieve"))
    at = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    told = rows.withColumn("_piece", F.bitmap_bucket_number(_bit(key))).join(pieces, "_piece", "left")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return told.filter(maybe).select(*rows.columns), told.filter(~maybe).select(*rows.columns)
