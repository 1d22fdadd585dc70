"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.store import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn, until nothing changes: every node's neighbours are
    hung on the smallest of them. Each step is a minimum per node, which shrinks before its
    shuffle, and a join on the node, whose heavy keys adaptive execution can split. Each step's
    links are written, so a lost executor costs a re-read. The number of steps grows with the
    logarithm of the longest chain and is not bounded by a parameter. No links give no rows; extra
    columns are left alone.
    """
    pairs = links.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    pairs = materialise(pairs.distinct(), "links")
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.filter("u != v").unionByName(low.select("u", F.col("low").alias("v")))
        pairs = materialise(small.distinct(), "links")
        before, state = state, _state(pairs)
        if before == state:
            break
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    sums = pairs.agg(
        F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")),
        F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v")),
    )
    return tuple(sums.first())
