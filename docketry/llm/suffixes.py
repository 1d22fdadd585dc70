"""Removal of byte strings that stand anywhere else in the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.sieve import split
from docketry.llm.textops import byte_values, chunks, covered, minimizers, mix, small_batches, span_hashes
from docketry.store import free, materialise

GRAM = 64
STEP = 49
ROWS_PER_BATCH = 100_000
KEY = ["id", "text_hash"]
NO_ID = -(1 << 63)
# Pieces that a task sorts at once, some 10 MB of edges; what is found is the same for any number.
BUCKET_ROWS = 50_000
RESULT = {"kept": T.BinaryType(), "kept_text": T.StringType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}


def _grams(text: np.ndarray) -> np.ndarray:
    at = np.arange(max(len(text) - GRAM + 1, 0))
    return span_hashes(byte_values(text), at, at + GRAM)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for chunk in chunks(column):
        for i in range(len(chunk)):
            yield chunk.first_row + i, chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]


def _emit(batch: pa.RecordBatch, rows: list[np.ndarray], columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """The key columns of the given rows beside the collected values."""
    taken = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))
    values = [pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)) for parts in columns.values()]
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in KEY), *values], [*KEY, *columns])


def _anchors(length: int):
    """The anchors of each text, and how often each is chosen in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], {"anchor": [], "n": []}
            for i, text in _texts(batch.column("text")):
                if len(text) >= length:
                    grams = _grams(text)
                    anchors, n = np.unique(grams[minimizers(grams, length - GRAM + 1)[1]], return_counts=True)
                    rows.append(np.full(len(anchors), i))
                    out["anchor"].append(anchors.view(np.int64))
                    out["n"].append(n)
            yield _emit(batch, rows, out)

    return work


def _samples(length: int):
    """The sampled places of each text with the prints of their cores and of their whole pieces.

    Samples stand every STEP bytes to the left of a recurring anchor, as far as a string of
    `length` bytes reaches. The core of a sample at `at` is what all strings that begin at most
    STEP - 1 bytes before it have in common; its piece is all that they reach.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.arange(0, length - GRAM + 1, STEP)
        core = length - STEP + 1
        for batch in batches:
            anchors = batch.column("anchors")
            rows, held, out = [], 0, {"core": [], "piece": [], "at": []}
            for i, text in _texts(batch.column("text")):
                own = np.asarray(anchors[i].values).view(np.uint64)
                grams = _grams(text)
                chosen = minimizers(grams, length - GRAM + 1)[1]
                chosen = chosen[np.isin(grams[chosen], own)]
                at = np.unique((chosen[:, None] - back[None, :]).ravel())
                at = at[(at >= 0) & (at + core <= len(text))]
                low, high = np.maximum(at - STEP + 1, 0), np.minimum(at + length, len(text))
                values = byte_values(text)
                clipped = (at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - at).astype(np.uint64)
                rows.append(np.full(len(at), i))
                out["core"].append(span_hashes(values, at, at + core).view(np.int64))
                out["piece"].append(mix(span_hashes(values, low, high, 1) + clipped).view(np.int64))
                out["at"].append(at)
                held += len(at)
                if held >= ROWS_PER_BATCH:
                    yield _emit(batch, rows, out)
                    rows, held, out = [], 0, {k: [] for k in out}
            yield _emit(batch, rows, out)

    return work


def _starts_before(samples: np.ndarray, length: int, size: int) -> np.ndarray:
    """All starts of whole strings whose nearest sample is one of these."""
    starts = np.unique((samples[:, None] - np.arange(STEP)[None, :]).ravel())
    return starts[(starts >= 0) & (starts + length <= size)]


def _edges(length: int):
    """What stands around the cores of the given samples: up to STEP - 1 bytes on the left and on the right."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = length - STEP + 1
        for batch in batches:
            rows, out, left, right = [], {"at": [], "core": []}, [], []
            for i, text in _texts(batch.column("text")):
                samples = batch.column("samples")[i].values
                at = np.asarray(samples.field(0))
                rows.append(np.full(len(at), i))
                out["at"].append(at)
                out["core"].append(np.asarray(samples.field(1)))
                left += [text[max(s - STEP + 1, 0) : s].tobytes() for s in at.tolist()]
                right += [text[s + core : s + length].tobytes() for s in at.tolist()]
            found = _emit(batch, rows, out)
            yield pa.RecordBatch.from_arrays(
                [*found.columns, pa.array(left, pa.binary()), pa.array(right, pa.binary())], [*found.schema.names, "left", "right"]
            )

    return work


BUCKET = ["core", "a", "b", "tag"]
EDGES = ", ".join(f"{k} bigint" for k in KEY) + ", at bigint, core bigint, `left` binary, `right` binary"


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_hash, start) of the suffixes that agree with a neighbour, bucket after bucket.

    Batches come in the order of their buckets; a bucket that goes on in the next batch waits for it.
    """
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
        new = _bucket_numbers(table)
        whole = int(np.searchsorted(new, new[-1])) if len(new) else 0
        waiting = table.slice(whole)
        if whole:
            yield _equal_neighbours(table.slice(0, whole), new[:whole])
    if waiting is not None and len(waiting):
        yield _equal_neighbours(waiting, _bucket_numbers(waiting))


def _bucket_numbers(table: pa.Table) -> np.ndarray:
    """Numbers from 0 of the buckets of rows that are ordered by bucket."""
    keys = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in BUCKET])
    return np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(1)][: len(keys)])


def _equal_neighbours(table: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
    """Sort the suffixes of some buckets and mark those that agree over the whole length with the next.

    All suffixes of a bucket that begin k bytes before their sample read: k bytes of the left edge,
    the core, 48 - k bytes of the right edge. Their long common part, the core, has the same rank in the
    bucket, so the edges decide: 48 bytes are compared in place of the whole length.
    """
    reach = STEP - 1
    edges = np.zeros((len(table), 2 * reach), np.uint8)
    sizes = []
    for name, place in (("left", -1), ("right", 1)):
        column = table.column(name).combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        size = np.diff(offsets)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        first = reach - size if place < 0 else np.full(len(size), reach)
        edges[row, first[row] + inside] = data[offsets[0] : offsets[-1]]
        sizes.append(size)
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    rows_found, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = table.column("at").to_numpy()
    for k in range(reach + 1):
        asked = np.flatnonzero((sizes[0] >= k) & (sizes[1] >= reach - k) & (a <= k) & (k <= reach - b))
        if len(asked) < 2:
            continue
        words = np.ascontiguousarray(edges[asked, reach - k : 2 * reach - k]).view(">u8").astype(np.uint64)
        order = np.lexsort([*words.T[::-1], bucket[asked]])
        sorted_words, sorted_bucket = words[order], bucket[asked][order]
        same = (sorted_bucket[1:] == sorted_bucket[:-1]) & (sorted_words[1:] == sorted_words[:-1]).all(1)
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = asked[order[twice]]
        rows_found.append(found)
        starts.append(at[found] - k)
    take = pa.array(np.concatenate(rows_found))
    columns = [table.column(k).combine_chunks().take(take) for k in KEY]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(starts))], [*KEY, "start"])


def _recurring_starts(edges: DataFrame) -> DataFrame:
    """(id, text_hash, start) of the strings that two different pieces around one core share.

    A bucket holds the pieces with one core. Two of them share a string with k bytes left of the
    core only if they agree in k bytes on the left and 48 - k on the right, so in at least half of
    the 48 on one side. A bucket of more than `BUCKET_ROWS` pieces is therefore dealt anew, once by more
    bytes of the left edge and once by more of the right, until buckets are small or all 48 bytes
    are used up. Then what is left of the bucket is one string, which needs no sorting.
    """
    reach = STEP - 1
    rows = edges.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("tag"))
    rows = materialise(rows, "bucket_rows")
    small, used = [], [rows]
    while True:
        sizes = rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sizes = materialise(sizes, "buckets")
        used.append(sizes)
        whole = F.col("a") + F.col("b") == reach
        told = rows.join(sizes, BUCKET)
        small.append(told.filter((F.col("size") <= BUCKET_ROWS) | whole).drop("size"))
        heavy = told.filter((F.col("size") > BUCKET_ROWS) & ~whole).drop("size")
        if sizes.filter((F.col("size") > BUCKET_ROWS) & ~whole).isEmpty():
            break
        rest = reach - F.col("a") - F.col("b")
        half = F.ceil(rest / 2).cast("int")
        sides = F.array(
            F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")),
            F.struct(F.col("a").alias("a"), (F.col("b") + rest - half + 1).alias("b")),
        )
        dealt = heavy.select(*edges.columns, "tag", F.explode(sides).alias("side"))
        dealt = dealt.filter("octet_length(`left`) >= side.a and octet_length(`right`) >= side.b")
        shared = F.xxhash64("tag", "side", F.expr("right(hex(`left`), 2 * side.a)"), F.expr("left(hex(`right`), 2 * side.b)"))
        rows = materialise(dealt.select(*edges.columns, "side.a", "side.b", shared.alias("tag")), "bucket_rows")
        used.append(rows)
    settled, sorted_ones = [], []
    for part in small:
        settled.append(part.filter(F.col("a") + F.col("b") == reach).select(*KEY, (F.col("at") - F.col("a")).alias("start")))
        sorted_ones.append(part.filter(F.col("a") + F.col("b") < reach))
    ordered = reduce(DataFrame.unionByName, sorted_ones).repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    found = ordered.mapInArrow(_sort_buckets, ", ".join(f"{k} bigint" for k in KEY) + ", start bigint")
    starts = reduce(DataFrame.unionByName, settled, found).groupBy(*KEY).agg(F.collect_set("start").alias("starts"))
    starts = materialise(starts, "starts")
    free(*used)
    return starts


def _remove(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            is_copy = batch.column("copy").to_pylist()
            samples, starts = batch.column("samples"), batch.column("starts")
            kept, kept_text, n_bytes, n_removed, n_spans = [], [], [], [], []
            for i, text in _texts(batch.column("text")):
                if is_copy[i] and len(text) >= length:
                    gone = np.ones(len(text), bool)
                else:
                    found = [np.zeros(0, np.int64)]
                    if samples[i].is_valid:
                        found.append(_starts_before(np.asarray(samples[i].values), length, len(text)))
                    if starts[i].is_valid:
                        found.append(np.asarray(starts[i].values))
                    gone = covered(np.concatenate(found).astype(np.int64), length, len(text))
                kept.append(text[~gone].tobytes())
                kept_text.append(kept[-1].decode("utf-8", "replace"))
                n_bytes.append(len(text))
                n_removed.append(int(np.count_nonzero(gone)))
                n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rest"), pa.array(kept, pa.binary()), pa.array(kept_text, pa.string()), pa.array(n_bytes, pa.int64()),
                    pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                ],
                ["rest", *RESULT],
            )

    return work


def remove_repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """`rest` (all columns but text), kept (bytes), kept_text, n_bytes, n_removed and n_spans per row of `docs`.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in its own text
    or another row's. Strings never cross texts; a removed run is maximal. kept_text is `kept` as
    text; a character that was cut in two leaves a replacement character there.

    Suffixes are sorted over their first `length` bytes, bucket by bucket, with a cover sample in
    place of long comparisons:

    1. Whole texts that occur twice are settled; one row stands for them in what follows.
    2. Anchors: of each string's 64-byte runs the one with the smallest hash. Equal strings have
       equal anchors at equal places, so a string can recur only if its anchor does. Some 6 places
       in 1,000 are anchors; suffixes without a recurring one are left out.
    3. Cover sample: the places every `STEP` bytes before a recurring anchor. Two suffixes with the
       same anchor reach a sample after the same number of bytes, less than `STEP`: what a
       difference cover promises for any two places holds for all that can be equal. A sample's rank
       is a print of its core, the bytes that all strings starting shortly before it share, so
       equal cores have equal ranks and long ties are never compared byte by byte.
    4. A bucket is the suffixes whose sample has one rank. If all its pieces (the bytes its strings
       reach) are equal, it is settled as a whole; a rank that occurs once cannot recur.
    5. The other buckets are sorted, each distinct piece once, by the bytes before and after the
       core; suffixes that agree with a neighbour recur. A task holds some buckets at a time, and a
       bucket of more than `BUCKET_ROWS` pieces is dealt into smaller ones first
       (`_recurring_starts`), so memory is bounded whatever a third of all texts have in common.

    Groups are counts with partial counts. Texts are only moved if they may hold such a suffix;
    a bitmap of fixed size tells (`sieve`). Written tables are freed once they are used up.

    A null text is empty, and so is what is kept of it. A text of any length is one row. Rows with
    a null or repeated doc_id are texts like any others; the same row twice is a whole text that
    occurs twice. An empty table gives no rows. Other columns, whatever their names, stay inside
    `rest`.
    """
    if length < GRAM + STEP:
        raise ValueError(f"strings must have {GRAM + STEP} bytes or more")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
        rest.alias("rest"),
    )
    texts = rows.select(*KEY, "text")
    ints = ", ".join(f"{k} bigint" for k in KEY)
    anchors = materialise(texts.mapInArrow(_anchors(length), f"{ints}, anchor bigint, n bigint"), "anchors")
    copies = materialise(_copies(rows), "copies")
    recurring = anchors.groupBy("anchor").agg(
        F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.max("n").alias("n")
    )
    own = anchors.join(recurring.filter("a < b or n > 1").select("anchor"), "anchor")
    own = own.groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors"))
    own = materialise(own.join(copies.filter("not stands_for"), KEY, "left_anti"), "own_anchors")
    free(anchors)

    samples = materialise(
        split(texts, own, KEY)[0].join(own, KEY).select(*KEY, "text", "anchors").mapInArrow(
            _samples(length), f"{ints}, core bigint, piece bigint, at bigint"
        ),
        "samples",
    )
    free(own)
    pieces = samples.groupBy("core", "piece").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "at")).alias("first")
    )
    pieces = materialise(pieces, "pieces")
    settled = samples.join(pieces.filter("n > 1").select("core", "piece"), ["core", "piece"])
    settled = materialise(settled.groupBy(*KEY).agg(F.collect_set("at").alias("samples")), "settled")
    free(samples)
    mixed = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").select("core")
    told_apart = pieces.join(mixed, "core").groupBy("first.id", "first.text_hash")
    told_apart = materialise(told_apart.agg(F.collect_set(F.struct("first.at", "core")).alias("samples")), "told_apart")
    free(pieces)
    edges = split(texts, told_apart, KEY)[0].join(told_apart, KEY).select(*KEY, "text", "samples")
    starts = _recurring_starts(edges.mapInArrow(_edges(length), EDGES))
    free(told_apart)

    copied = copies.select(*KEY, F.lit(True).alias("copy")).distinct()
    found = materialise(settled.join(starts, KEY, "full").join(copied, KEY, "full"), "found")
    free(settled, starts, copies)
    schema = T.StructType([rows.schema["rest"], *(T.StructField(n, t) for n, t in RESULT.items())])
    maybe, never = split(rows, found, KEY)
    columns = ["rest", "text", "samples", "starts", "copy"]
    joined = maybe.join(found, KEY, "left").select(*columns)
    nothing = {c: F.lit(None).cast(found.schema[c].dataType) for c in ("samples", "starts", "copy")}
    both = joined.unionByName(never.withColumns(nothing).select(*columns))
    return both.withColumn("copy", F.coalesce("copy", F.lit(False))).mapInArrow(_remove(length), schema)


def _copies(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose whole text occurs twice, told by 96 bits of its hashes; one stands for all."""
    named = rows.select(*KEY, F.hash("text").alias("text_hash_2"))
    groups = named.groupBy("text_hash", "text_hash_2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    both = named.join(groups.filter("n > 1"), ["text_hash", "text_hash_2"])
    return both.select(*KEY, (F.col("id") == F.col("first")).alias("stands_for")).distinct()
