"""Near-duplicate documents by one-permutation MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.graph import components
from docketry.llm.textops import Chunk, chunks, mix, span_hashes, word_hashes
from docketry.store import materialise

# Sizes of steps; the links found are the same for any of them.
MEMBERS_PER_TASK_GROUP = 256
STAR_TURNS = 3
SHINGLES_PER_BATCH = 100_000


def shingle_sets(chunk: Chunk, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk; a short text is one shingle."""
    starts, ends, first = chunk.words()
    hashes = word_hashes(chunk.data, starts, ends)
    at = np.arange(max(len(hashes) - words + 1, 0))
    grams = span_hashes(hashes, at, at + words)
    sets = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= words:
            sets.append(np.unique(grams[low : high - words + 1]))
        elif high > low:
            short = span_hashes(hashes[low:high], np.array([0]), np.array([high - low]), 1)
            sets.append(mix(short + np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each bin, empty bins filled from others.

    The filling is the optimal densification: an empty bin tries bins in an order of its own,
    the same for all documents, until it meets one that is not empty.
    """
    values = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    bin_of = (values % np.uint64(bins)).astype(np.int64)
    full = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(full, bin_of, values)
    filled = np.zeros(bins, bool)
    filled[bin_of] = True
    out, empty, attempt = full.copy(), np.flatnonzero(~filled), 0
    while len(empty):
        attempt += 1
        donor = (mix(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = filled[donor]
        out[empty[found]] = full[donor[found]]
        empty = empty[~found]
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    rows = sig.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for column in rows.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _signatures(words: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys = [], [], []
            for chunk in chunks(batch.column("text"), lower=True):
                for shingles in shingle_sets(chunk, words):
                    counts.append(len(shingles))
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    keys.append(band_keys(signature(shingles, bands * rows), bands) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    return work


def _compare(words: int, percent: int):
    """Rows come sorted by centre and salt, the centre's own text before those of its members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, group = np.zeros(0, np.uint64), None
        for batch in batches:
            a, salt = batch.column("a").to_numpy(), batch.column("salt").to_numpy()
            b = batch.column("b").to_numpy(zero_copy_only=False)
            is_member = batch.column("member").to_numpy(zero_copy_only=False)
            linked = np.zeros(len(a), bool)
            for chunk in chunks(batch.column("text"), lower=True):
                for i, shingles in enumerate(shingle_sets(chunk, words), chunk.first_row):
                    if not is_member[i]:
                        centre, group = shingles, (a[i], salt[i])
                    elif group == (a[i], salt[i]) and len(centre) and len(shingles):
                        place = np.minimum(np.searchsorted(centre, shingles), len(centre) - 1)
                        common = int(np.count_nonzero(centre[place] == shingles))
                        linked[i] = 100 * common >= percent * (len(centre) + len(shingles) - common)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[is_member]), pa.array(b[is_member]), pa.array(linked[is_member])],
                ["a", "b", "linked"],
            )

    return work


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) for each pair, compared on the whole sets of both texts.

    The centre `a` of many pairs is sent once per group of members, so no task gets all of them
    and no text is repeated for each pair.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK_GROUP).alias("salts"))
    salted = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    members = salted.join(texts.withColumnRenamed("doc_id", "b"), "b").select(
        "a", "salt", F.lit(True).alias("member"), "b", "text"
    )
    centres = (
        sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
        .join(texts.withColumnRenamed("doc_id", "a"), "a")
        .select("a", "salt", F.lit(False).alias("member"), F.lit(-1).cast("bigint").alias("b"), "text")
    )
    together = centres.unionByName(members).repartition("a", "salt")
    return together.sortWithinPartitions("a", "salt", "member").mapInArrow(
        _compare(words, percent), "a bigint, b bigint, linked boolean"
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text).

    1. Each text becomes its set of distinct shingles of `words` lower-cased words, a 128-bit
       digest of the set, and a one-permutation MinHash signature cut into bands. Texts with
       equal sets are one class and go on as one, the smallest doc_id.
    2. Classes that share a band's key share a bucket. A bucket's candidates form a star: one
       member is compared with all others, so the pairs grow with the bucket, not its square.
    3. Pairs are confirmed on the whole sets: 100 * common >= `percent` * union.
    4. Members of a bucket that are still in different components are compared by
       `STAR_TURNS` stars in all, each with another centre. What is open then (texts far from
       all others in a large bucket) is told apart by the rarest shingles of the whole sets,
       which is exact (see _sharing_heads): no link is lost by the stars, nothing is capped and
       no group is compared all with all.

    With 32 bands of 4 rows a pair at 0.8 misses every bucket with probability below 1e-7.

    A null or empty text has no shingles and is linked with nothing; a text of fewer than
    `words` words is one shingle. Rows that share a doc_id are one document, compared by the text
    whose hash is smallest; each row gets its own n_shingles. A null doc_id is linked with
    nothing, has no component and is kept. A text of any length is one set of hashes. An empty
    table gives no rows; columns beside doc_id and text are left alone, whatever their names.
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    signed = materialise(
        docs.mapInArrow(
            _signatures(words, bands, rows),
            "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>",
        ),
        "signatures",
    )
    one = F.struct("text_hash", "digest", F.col("n_shingles").alias("size"), "bands")
    present = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min_by(one, "text_hash").alias("one"))
        .select("doc_id", "one.*")
    )
    own = F.min_by(F.struct("text_hash", "size", "bands"), "doc_id")
    classes = materialise(
        present.groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), own.alias("own"))
        .select("digest", "rep", "own.*"),
        "classes",
    )
    copies = present.join(classes.select("digest", "rep"), "digest").filter("doc_id != rep")
    links = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    keyed = classes.select("rep", "text_hash", "size", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = materialise(keyed.join(shared.select("bucket"), "bucket"), "buckets")
    needed = buckets.select(F.col("rep").alias("doc_id"), "text_hash").distinct()
    texts = docs.join(needed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text")
    texts = materialise(texts, "texts")
    links = links.unionByName(_candidate_links(buckets, texts, words, percent))
    labels = components(links)
    joined = signed.join(labels, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _candidate_links(buckets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links between classes that share a bucket.

    A centre leaves its bucket after its turn, as it was compared with all others there, and the
    components that a turn's links join are renamed. Only buckets with more than one component
    stay open.
    """
    open_rows = buckets.select("bucket", "rep", "size", F.col("rep").alias("component"))
    confirmed = buckets.sparkSession.createDataFrame([], "a bigint, b bigint, linked boolean")
    for turn in range(STAR_TURNS + 1):
        if open_rows.isEmpty():
            break
        last = turn == STAR_TURNS
        if last:
            pairs = _sharing_heads(open_rows, texts, words, percent)
        else:
            order = F.struct(F.xxhash64("rep", F.lit(turn)), "rep") if turn else F.col("rep")
            centres = open_rows.groupBy("bucket").agg(
                F.min_by(F.struct("rep", "size", "component"), order).alias("centre")
            )
            stars = open_rows.join(centres, "bucket").select(
                "*", *[F.col(f"centre.{c}").alias(f"{c}_2") for c in ("rep", "size", "component")]
            )
            open_rows = stars.filter("rep != rep_2").select("bucket", "rep", "size", "component")
            pairs = stars.filter("component != component_2")
        forward = F.col("rep") < F.col("rep_2")
        pairs = (
            pairs.filter(100 * F.least("size", "size_2") >= percent * F.greatest("size", "size_2"))
            .select(
                F.least("rep", "rep_2").alias("a"),
                F.greatest("rep", "rep_2").alias("b"),
                F.when(forward, F.col("component")).otherwise(F.col("component_2")).alias("part_a"),
                F.when(forward, F.col("component_2")).otherwise(F.col("component")).alias("part_b"),
            )
            .distinct()
        )
        if turn:
            pairs = pairs.join(confirmed.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "candidates")
        found = materialise(confirm(pairs.select("a", "b"), texts, words, percent), "confirmed")
        confirmed = confirmed.unionByName(found) if turn else found
        if last:
            break
        joined = pairs.join(found.filter("linked"), ["a", "b"])
        renamed = components(joined.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
        renamed = renamed.select(F.col("node").alias("component"), F.col("component").alias("renamed"))
        open_rows = open_rows.join(renamed, "component", "left").select(
            "bucket", "rep", "size", F.coalesce("renamed", "component").alias("component")
        )
        unsettled = open_rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        open_rows = materialise(open_rows.join(unsettled.filter("low < high").select("bucket"), "bucket"), "buckets")
    return confirmed.filter("linked").select("a", "b")


def _shingles(words: int):
    """One row for each distinct shingle of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for chunk in chunks(batch.column("text"), SHINGLES_PER_BATCH, lower=True):
                sets = shingle_sets(chunk, words)
                own = np.repeat(ids[chunk.first_row : chunk.first_row + len(sets)], [len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(flat)], ["rep", "shingle"])

    return work


def _sharing_heads(open_rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of members of open buckets, of different components, that can still be similar.

    The shingles of each member are put in one order for all, rare ones first. If two sets are
    similar, their first common shingle stands so early in both that what follows it in either is
    enough for the overlap they need. So only the heads of the sets are joined, and pairs whose
    rest is too short fall away in the join; no similar pair does. A member whose head is its own
    alone has no partner and is settled without a pair.

    Of the members whose heads share a shingle, those of its largest component are joined with
    the others only, never with each other.
    """
    members = open_rows.select("rep", "size", "component").distinct()
    held = texts.join(members.select(F.col("rep").alias("doc_id")), "doc_id")
    shingles = materialise(held.mapInArrow(_shingles(words), "rep bigint, shingle bigint"), "shingles")
    recurring = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = (
        shingles.join(recurring, "shingle")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    )
    # Shingles that no other member has come first and need no row.
    heads = members.join(common, "rep").select(
        "rep", "size", "component", (F.col("size") - F.size("common")).alias("alone"), F.posexplode("common")
    )
    heads = heads.select(
        "rep", "size", "component", F.col("col.shingle").alias("shingle"),
        (F.col("size") - F.col("alone") - F.col("pos")).alias("rest"),
    ).filter(100 * F.col("rest") >= percent * F.col("size"))
    heads = materialise(heads, "heads")
    parts = heads.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("shingle").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")
    )
    shared = materialise(heads.join(largest.filter("parts > 1").drop("parts"), "shingle"), "shared_heads")
    other = shared.drop("largest").withColumnsRenamed({c: f"{c}_2" for c in ("rep", "size", "component", "rest")})
    enough = (100 + percent) * F.least("rest", "rest_2") >= percent * (F.col("size") + F.col("size_2"))
    once = (F.col("component_2") == F.col("largest")) | (F.col("rep") < F.col("rep_2"))
    pairs = shared.filter("component != largest").join(other, "shingle")
    return pairs.filter((F.col("component") != F.col("component_2")) & once & enough)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` but for the near-duplicates of a smaller doc_id (see near_duplicates).

    Rows with a null doc_id stay; of rows that share a doc_id all stay or none.
    """
    dropped = near_duplicates(docs, words, percent).filter(~F.col("kept"))
    dropped = materialise(dropped.select(F.col("doc_id").alias("_dropped_id")).distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"] == F.col("_dropped_id"), "left_anti")
