"""Interleaving of sources by target weights: Pfair windows, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.store import materialise

# Documents of one source are ranked by the digest of their id; rows per ranking group, about.
ROWS_PER_GROUP = 2_000
SLOTS_PER_BATCH = 50_000


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly their proportions; a float is the fraction it stands for."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def pfair(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """The source and block of each slot, until all blocks are used up.

    At share w (a source's weight by that of all sources with blocks left), its block i, counted
    from 0 when the present phase began, is released at floor(i / w) and due by ceil((i + 1) / w). Of
    the released blocks the one due first goes, then the heavier source's. Shares are exact
    fractions, so at every slot of a phase each source has had its share of the phase's slots,
    more or less than one block, however many slots there are and however small the share. When
    a source has no block left, a new phase shares its weight among the others.

    Holds one entry a source, never the schedule.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    whole = whole_weights({s: weights[s] for s in left}) if left else {}
    used = dict.fromkeys(left, 0)
    while left:
        names = sorted(left, key=lambda s: (-whole[s], s))
        total = sum(whole[s] for s in names)
        waiting = [(0, k, 0) for k in range(len(names))]  # release, source, block of the phase
        ready: list[tuple[int, int, int]] = []  # deadline, source, block of the phase
        slot = 0
        while len(left) == len(names):
            while waiting and waiting[0][0] <= slot:
                _, k, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // whole[names[k]]), k, i))
            _, k, i = heapq.heappop(ready)
            source = names[k]
            yield source, used[source]
            slot += 1
            used[source] += 1
            left[source] -= 1
            if left[source]:
                heapq.heappush(waiting, ((i + 1) * total // whole[source], k, i + 1))
            else:
                del left[source]


def _name(source: str | None) -> str:
    return "" if source is None else f"={source}"


def smoothed(counts: Mapping[str, int], power: float) -> dict[str, float]:
    """Weights by a power of the sources' sizes: below 1, small sources get more than their share."""
    return {s: n**power for s, n in counts.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    block_rows: int = 64,
) -> DataFrame:
    """`row` (all columns), rank, block and slot for every row of `docs`: its place in the mix.

    The mix is the order of (slot, rank). Each source's rows, ranked by a digest, form blocks of
    `block_rows`; a slot takes one block. Without `weights` they are the sources' sizes to the
    `power`. Blocks get the release times and deadlines of Pfair scheduling from the exact
    weights, and earliest deadline first interleaves them (`pfair`): at any slot of a phase a
    source has had its weight's share of the phase's slots up to less than one block. When a
    source is used up, a new phase shares its weight among the others: every row is placed
    exactly once.

    The driver gets one count per source, of any number of sources. The schedule, one short row
    per block, is streamed by one task and written; documents never pass through it. Ranks are
    counted in groups of about `ROWS_PER_GROUP` rows with neighbouring digests, so a heavy source
    is many groups.

    A null source is a source of its own. A source without a weight, or with one that is not
    positive, is an error. Rows with a null or repeated doc_id or text are ordinary rows; texts of
    any length only ride along. An empty table gives no rows. Other columns, whatever their
    names, stay inside `row`.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    named = docs.select(row.alias("row"), source.alias("name"))
    counts = {r["name"]: r["n"] for r in named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    chosen = smoothed(counts, power) if weights is None else {_name(s): w for s, w in weights.items()}
    if missing := [s for s in counts if not chosen.get(s, 0) > 0]:
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    schedule = spark.range(0, 1, 1, 1).mapInArrow(_schedule(blocks, chosen), "name string, block bigint, slot bigint")
    slots = materialise(schedule, "slots")

    groups = spark.createDataFrame(
        pa.table({"name": pa.array(counts, pa.string()), "groups": pa.array([-(-n // ROWS_PER_GROUP) for n in counts.values()], pa.int64())})
    )
    digest = F.md5(F.concat_ws(":", F.col("row.doc_id").cast("string"), F.xxhash64("row.text").cast("string")))
    grouped = (
        named.join(groups, "name")
        .withColumn("digest", digest)
        .withColumn("place", F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"))
        .withColumn("group", F.expr("place * groups div 4294967296"))
        .select("row", "name", "digest", "group")
    )
    sizes = materialise(grouped.groupBy("name", "group").agg(F.count(F.lit(1)).alias("n")), "groups")
    before = W.partitionBy("name").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("name", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("name", "group").orderBy("digest")
    ranked = (
        grouped.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, ["name", "group"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .withColumn("block", F.expr(f"rank div {int(block_rows)}"))
    )
    return ranked.join(slots, ["name", "block"]).select("row", "rank", "block", "slot")


def _schedule(blocks: Mapping[str, int], weights: Mapping[str, float]):
    """The rows of the schedule, batch by batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            placed = enumerate(pfair(blocks, weights))
            while part := list(islice(placed, SLOTS_PER_BATCH)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": pa.array([s for _, (s, _) in part], pa.string()),
                        "block": pa.array([b for _, (_, b) in part], pa.int64()),
                        "slot": pa.array([k for k, _ in part], pa.int64()),
                    }
                )

    return work
