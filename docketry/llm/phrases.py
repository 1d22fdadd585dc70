"""Removal of word passages that an earlier document already has."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.sieve import split
from docketry.llm.textops import chunks, minimizers, sliding_min, small_batches, span_hashes, word_hashes
from docketry.store import free, materialise

PATTERN_WORDS_PER_SHARD = 200_000
DOCUMENTS_PER_TEAM = 2000
KEY = ["doc_id", "text_hash"]
RESULT = {"kept_text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType()}


def _grams(chunk, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of all runs of `gram` words, and the first word of each text."""
    starts, ends, first = chunk.words()
    words = word_hashes(chunk.data, starts, ends)
    at = np.arange(max(len(words) - gram + 1, 0))
    return words, span_hashes(words, at, at + gram), first


def _anchors(window: int, gram: int):
    """The chosen word runs of each text: every window of a text holds at least one of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for chunk in chunks(batch.column("text")):
                _, grams, first = _grams(chunk, gram)
                for i, (low, high) in enumerate(zip(first[:-1], first[1:]), chunk.first_row):
                    if high - low >= window:
                        own = grams[low : high - gram + 1]
                        chosen = np.unique(own[minimizers(own, window - gram + 1)[1]])
                        found.append(chosen)
                        rows.append(np.full(len(chosen), i))
            take = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
            anchors = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), *(batch.column(k).take(pa.array(take)) for k in KEY)], ["anchor", *KEY]
            )

    return work


def _windows(window: int, gram: int):
    """The windows of a text that hold one of its recurring anchors: a 96-bit fingerprint, the place, the anchor's home."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column("anchors")
            rows, places, prints, checks, homes = [], [], [], [], []
            for chunk in chunks(batch.column("text")):
                words, grams, first = _grams(chunk, gram)
                for i, (low, high) in enumerate(zip(first[:-1], first[1:]), chunk.first_row):
                    own = np.asarray(anchors[i].values.field(0)).view(np.uint64)
                    home = np.asarray(anchors[i].values.field(1))
                    order = np.argsort(own)
                    lowest = sliding_min(grams[low : high - gram + 1], window - gram + 1)
                    among = np.minimum(np.searchsorted(own[order], lowest), len(own) - 1)
                    at = np.flatnonzero(own[order][among] == lowest)
                    sequence = words[low:high]
                    rows.append(np.full(len(at), i))
                    places.append(at)
                    homes.append(home[order][among[at]])
                    prints.append(span_hashes(sequence, at, at + window))
                    checks.append(span_hashes(sequence, at, at + window, 1))
            none = np.zeros(0, np.int64)
            take = pa.array(np.concatenate([*rows, none]).astype(np.int64))
            prints = np.concatenate([*prints, none.view(np.uint64)]).view(np.int64)
            checks = np.concatenate([*checks, none.view(np.uint64)]).astype(np.uint32).view(np.int32)
            places = np.concatenate([*places, none]).astype(np.int32)
            homes = np.concatenate([*homes, none]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints), pa.array(checks), *(batch.column(k).take(take) for k in KEY), pa.array(places), pa.array(homes)],
                ["print", "check", *KEY, "place", "home"],
            )

    return work


def _passages(window: int):
    """The passages of each text: its confirmed windows of one home that follow each other, as words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, homes, sizes, passages = [], [], [], []
            doc_ids = batch.column("doc_id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                found = batch.column("confirmed")[i].values
                home, place = np.asarray(found.field(0)), np.asarray(found.field(1)).astype(np.int64)
                order = np.lexsort((place, home))
                home, place = home[order], place[order]
                new = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (place[1:] != place[:-1] + 1)])
                last = np.r_[new[1:], len(place)] - 1
                for a, b in zip(new.tolist(), last.tolist()):
                    passage = words[place[a] : place[b] + window]
                    owners.append(doc_ids[i])
                    homes.append(int(home[a]))
                    sizes.append(len(passage))
                    passages.append(b" ".join(passage).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(homes, pa.int64()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64()), pa.array(passages, pa.string())],
                ["home", "owner", "size", "passage"],
            )

    return work


def _agree_after(a: list[int], i: int, b: list[int], j: int) -> int:
    """How many numbers from a[i] and from b[j] on agree."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 16
    while n < most:
        step = min(2 * step, most - n)
        if a[i + n : i + n + step] != b[j + n : j + n + step]:
            while a[i + n] == b[j + n]:
                n += 1
            return n
        n += step
    return n


def _agree_before(a: list[int], i: int, b: list[int], j: int) -> int:
    """How many numbers before a[i] and before b[j] agree."""
    n, most, step = 0, min(i, j), 16
    while n < most:
        step = min(2 * step, most - n)
        if a[i - n - step : i - n] != b[j - n - step : j - n]:
            while a[i - n - 1] == b[j - n - 1]:
                n += 1
            return n
        n += step
    return n


class Shard:
    """Confirmed passages and their automaton, whose letters are whole words.

    The automaton holds a block of each passage every half window, so any shared window has a
    whole block in it. A block found in a text is compared on with the passage, word by word, to
    both sides; what agrees over a window or more is an occurrence.
    """

    def __init__(self, window: int, passages: list[tuple[int, list[bytes]]]):
        """Each passage comes with the doc_id that owns it."""
        self.window, self.number, self.passages = window, {}, []
        number = self.number
        for owner, words in passages:
            self.passages.append((owner, [number.setdefault(w, len(number) + 1) for w in words]))
        step = max(window // 2, 1)
        self.block = window - step + 1
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, ids) in enumerate(self.passages):
            for at in range(0, len(ids) - self.block + 1, step):
                places.setdefault(tuple(ids[at : at + self.block]), []).append((k, at))
        self.places = list(places.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, block in enumerate(places):
            self.automaton.add_word(block, k)
        self.automaton.make_automaton()

    def locate(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of what the text shares, over a window or more, with a passage of a smaller doc_id."""
        number = self.number
        ids = [number.get(w, 0) for w in words]
        spans, reach = set(), {}
        if not self.places:
            return []
        for end, k in self.automaton.iter(tuple(ids)):
            start = end - self.block + 1
            for passage, at in self.places[k]:
                owner, own = self.passages[passage]
                if owner >= doc_id or reach.get((passage, start - at), -1) > end:
                    continue
                low = start - _agree_before(ids, start, own, at)
                high = end + 1 + _agree_after(ids, end + 1, own, at + self.block)
                reach[passage, start - at] = high
                if high - low >= self.window:
                    spans.add((low, high))
        return sorted(spans)


def _copies(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose whole text a smaller doc_id has, told by 96 bits of its hashes."""
    named = rows.select(*KEY, F.hash("text").alias("text_hash_2"))
    firsts = named.groupBy("text_hash", "text_hash_2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.filter("first < last").drop("last")
    return named.join(firsts, ["text_hash", "text_hash_2"]).filter("doc_id > first").select(*KEY).distinct()


def _locate(window: int):
    def work(passages: pa.Table, texts: pa.Table) -> pa.Table:
        owners, stored = passages.column("owner").to_pylist(), passages.column("passage").to_pylist()
        shard = Shard(window, [(o, p.encode().split()) for o, p in zip(owners, stored)])
        ids, spans, rows = texts.column("doc_id").to_pylist(), [], []
        for i, text in enumerate(texts.column("text")):
            found = shard.locate(ids[i], (text.as_py() or "").encode().split())
            spans += found
            rows += [i] * len(found)
        take = pa.array(rows, pa.int64())
        low, high = (pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1))
        keys = [texts.column(k).combine_chunks().take(take) for k in KEY]
        return pa.Table.from_arrays([*keys, low, high], [*KEY, "low", "high"])

    return work


def _remove(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, is_copy, spans = batch.column("text"), batch.column("copy").to_pylist(), batch.column("spans")
            kept, n_words, n_removed = [], [], []
            for i in range(len(batch)):
                words = (texts[i].as_py() or "").encode().split()
                n_words.append(len(words))
                if is_copy[i] and len(words) >= window:
                    words = []
                elif spans[i].is_valid:
                    gone = np.zeros(len(words), bool)
                    for span in spans[i].as_py():
                        gone[span["low"] : span["high"]] = True
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), texts, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                ["rest", "text", "kept_text", "n_words", "n_removed"],
            )

    return work


def _confirmed(named: DataFrame, copies: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The documents that hold recurring anchors, and the passages confirmed among them.

    An anchor's home is the smallest doc_id that has it. A window is confirmed if two documents have
    it; it is kept once, where the smallest doc_id has it first.
    """
    anchors = materialise(
        named.select(*KEY, "text").mapInArrow(_anchors(window, gram), "anchor bigint, doc_id bigint, text_hash bigint"),
        "anchors",
    )
    recurring = anchors.groupBy("anchor").agg(
        F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.min("doc_id").alias("home")
    )
    recurring = recurring.filter("a < b").select("anchor", "home")
    own = anchors.join(recurring, "anchor").groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "home")).alias("anchors"))
    own = materialise(own.join(copies, KEY, "left_anti"), "own_anchors")
    free(anchors)
    texts = named.select(*KEY, "text")
    windows = split(texts, own, KEY)[0].join(own, KEY).select(*KEY, "text", "anchors").mapInArrow(
        _windows(window, gram), "print bigint, check int, doc_id bigint, text_hash bigint, place int, home bigint"
    )
    earliest = windows.groupBy("print", "check").agg(
        F.min(F.struct(*KEY, "place", "home")).alias("at"), F.max("doc_id").alias("last")
    )
    confirmed = earliest.filter("at.doc_id < last").groupBy("at.doc_id", "at.text_hash")
    confirmed = confirmed.agg(F.collect_list(F.struct("at.home", "at.place")).alias("confirmed"))
    confirmed = materialise(confirmed, "confirmed")
    passages = split(texts, confirmed, KEY)[0].join(confirmed, KEY)
    passages = passages.select("doc_id", "text", "confirmed").mapInArrow(
        _passages(window), "home bigint, owner bigint, size bigint, passage string"
    )
    passages = materialise(passages.distinct(), "passages")
    free(confirmed)
    return own, passages


def _occurrences(named: DataFrame, own: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, spans): where documents hold passages of smaller doc_ids, found by the automata.

    A passage goes to the shard of its home, a document to the shards of its anchors' homes. A
    shard with too many words is dealt into parts, each with all its documents; one with too many
    documents into teams, each with all its passages.
    """
    words = passages.agg(F.sum("size")).first()[0] or 0
    shards = -(-words // PATTERN_WORDS_PER_SHARD) or 1
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")
    stored = passages.select(shard, "owner", "size", "passage")
    home = F.explode(F.array_distinct(F.col("anchors.home")))
    routes = own.select(*KEY, home.alias("home")).filter("home < doc_id").select(*KEY, shard).distinct()
    routes = materialise(routes, "routes")
    parts = stored.groupBy("shard").agg(F.ceil(F.sum("size") / PATTERN_WORDS_PER_SHARD).cast("int").alias("parts"))
    parts = materialise(parts, "parts")
    teams = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / DOCUMENTS_PER_TEAM).cast("int").alias("teams"))
    teams = materialise(teams, "teams")
    deal = lambda n, *key: F.pmod(F.xxhash64(*key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = stored.join(parts, "shard").join(teams, "shard")
    stored = stored.select("shard", "owner", "passage", deal(F.col("parts"), "passage").alias("part"), every("teams").alias("team"))
    texts = split(named.select(*KEY, "text"), routes, KEY)[0].join(routes, KEY).join(parts, "shard").join(teams, "shard")
    texts = texts.select("shard", *KEY, "text", deal(F.col("teams"), *KEY).alias("team"), every("parts").alias("part"))
    group = ["shard", "part", "team"]
    found = stored.groupBy(*group).cogroup(texts.groupBy(*group)).applyInArrow(
        _locate(window), ", ".join(f"{c} bigint" for c in (*KEY, "low", "high"))
    )
    found = materialise(found.groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    free(routes, parts, teams)
    return found


def remove_repeated_passages(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """`rest` (all columns but text), text, kept_text, n_words and n_removed for every row of `docs`.

    A word goes if a window of `window` words over it also starts in a document with a smaller
    doc_id; kept words are joined by one space.

    0. A whole text that a smaller doc_id has loses all its words if it is as long as a window;
       such copies take no part in what follows.
    1. Anchors: of each window's runs of `gram` words the one with the smallest hash. Equal
       windows have equal anchors, so a window can recur only if its anchor does; about one run
       in 18 is an anchor.
    2. Passages are confirmed: the windows with a recurring anchor are grouped by a 96-bit
       fingerprint, and those of two documents are kept where the smallest doc_id has them.
       Windows that follow each other there are one passage.
    3. The passages are compiled into Aho-Corasick automata whose letters are whole words, sharded
       by the passages' homes (the smallest doc_id that has the anchor). All documents with a
       recurring anchor, others can hold no passage, are streamed through the shards of their
       anchors. Only what an automaton finds is removed, after a comparison word by word.

    A shard holds about `PATTERN_WORDS_PER_SHARD` words of passages and `DOCUMENTS_PER_TEAM`
    documents at a time; a passage that very many documents share is compiled for each team of
    them. The results are the same for any such sizes. Texts are only moved if a bitmap of fixed
    size asks for it (`sieve`); written tables are freed once they are used up.

    A null text has no words and stays null beside an empty kept_text; a text of any length is one
    row. A row with a null doc_id neither loses words nor makes others lose them. Rows that share a
    doc_id are each judged by their own text against smaller doc_ids, never against each other. An
    empty table gives no rows. Other columns, whatever their names, stay inside `rest`.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", rest.alias("rest")
    )
    named = rows.filter("doc_id is not null")
    copies = materialise(_copies(named), "copies")
    own, passages = _confirmed(named, copies, window, gram)
    found = _occurrences(named, own, passages, window)
    free(own, passages)
    changed = found.withColumn("copy", F.lit(False)).unionByName(
        copies.select(*KEY, F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy"))
    )
    changed = materialise(changed, "changed")
    free(found, copies)
    maybe, never = split(rows, changed, KEY)
    columns = ["rest", "text", "spans", "copy"]
    joined = maybe.join(changed, KEY, "left").select(*columns)
    nothing = {c: F.lit(None).cast(changed.schema[c].dataType) for c in ("spans", "copy")}
    both = joined.unionByName(never.withColumns(nothing).select(*columns))
    schema = T.StructType(
        [rows.schema["rest"], rows.schema["text"], *(T.StructField(n, t) for n, t in RESULT.items())]
    )
    return both.withColumn("copy", F.coalesce("copy", F.lit(False))).mapInArrow(_remove(window), schema)
