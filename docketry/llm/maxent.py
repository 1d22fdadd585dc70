"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.quality import bucket
from docketry.llm.textops import chunks, mix, word_hashes
from docketry.store import materialise

KEY = ["doc_id", "text_hash"]
TOKENS_PER_STEP = 20_000
# exp of a float32 this far from 0 neither overflows, summed over a thousand columns, nor vanishes.
SAFE = 80
# The end of a text is a token of its own; so is what stands before its beginning.
END = np.uint64(0xE4D0F7E47E4D0F7E)
BEGIN = np.uint64(0xBE610BE610BE610B)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; it is as large on any corpus."""

    buckets: int = 4096  # rows of each feature table
    classes: int = 32
    slots: int = 32  # words of a class; the last slot of the last class stands for all other words
    rounds: int = 6  # updates, each over its own part of the training texts
    rate: float = 0.4
    prior: float = 8.0
    floor: float = 0.05  # part of every probability that is the base's
    broadcast_tokens: int = 200_000  # tokens whose counts are sent to every task; the others are joined

    @property
    def words(self) -> int:
        return self.classes * self.slots - 1


def token_sequences(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and token hashes of each text: its lower-cased words and the end."""
    for chunk in chunks(texts, lower=True):
        starts, ends, first = chunk.words()
        words = word_hashes(chunk.data, starts, ends)
        for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), chunk.first_row):
            yield i, np.append(words[low:high], END)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    parts, held = [], 0
    for batch in batches:
        for _, tokens in token_sequences(batch.column("text")):
            parts.append(tokens)
            held += len(tokens)
            if held >= 4_000_000:
                yield summed(parts)
                parts, held = [], 0
    yield summed(parts)


class Model:
    """Tables of weights. A class is chosen by three features, a word of the class by two.

    Features: the word before, the word before that (a skip), and both together; for words of a
    class the first two with the class. Each is hashed to a row of its own table.
    """

    def __init__(self, shape: Shape, words: np.ndarray, counts: np.ndarray, outside: int):
        """`words` by falling count; `outside` is the base's mass of all other tokens, unknown ones too.

        Before any update the model is the base: slots have its masses, unused ones next to none.
        """
        self.shape = shape
        self.sorted = np.sort(words)
        self.slot_of = np.argsort(words)  # the n-th word of the vocabulary has slot n
        mass = np.full(shape.classes * shape.slots, 1e-6)
        mass[: len(words)] = counts + 1
        mass[-1] = outside
        mass = mass.reshape(shape.classes, shape.slots)
        self.share = mass.sum(1) / mass.sum()
        self.slot_share = mass / mass.sum(1, keepdims=True)
        size = (shape.buckets, shape.classes)
        self.tables = [np.zeros(size, np.float32) for _ in range(3)]
        self.tables += [np.zeros((shape.buckets, shape.slots), np.float32) for _ in range(2)]

    def slots(self, tokens: np.ndarray) -> np.ndarray:
        """The slot of each token; tokens outside the model's words share the last one."""
        if not len(self.sorted):
            return np.full(len(tokens), self.shape.classes * self.shape.slots - 1)
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return np.where(self.sorted[at] == tokens, self.slot_of[at], self.shape.classes * self.shape.slots - 1)

    def features(self, before: np.ndarray, skip: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        n, c = np.uint64(self.shape.buckets), cls.astype(np.uint64)
        keys = (
            before,
            skip + np.uint64(1),
            before * np.uint64(3) + skip,
            before + (c + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15),
            skip + (c + np.uint64(99)) * np.uint64(0xD1342543DE82EF95),
        )
        return [(mix(k) % n).astype(np.int64) for k in keys]

    def forward(self, before: np.ndarray, skip: np.ndarray, slot: np.ndarray):
        """Features, and the probabilities of all classes and of all words of the true class."""
        cls = slot // self.shape.slots
        rows = self.features(before, skip, cls)
        logits, inner = self.tables[0][rows[0]], self.tables[3][rows[3]]
        for k in (1, 2):
            logits += self.tables[k][rows[k]]
        inner += self.tables[4][rows[4]]
        logits += np.log(self.share).astype(np.float32)
        inner += np.log(self.slot_share).astype(np.float32)[cls]
        return rows, cls, slot % self.shape.slots, softmax(logits), softmax(inner)

    def log10(self, before: np.ndarray, skip: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The slots' log probabilities, with `floor` of the base's, so none is less than that part of it."""
        _, cls, inside, p, q = self.forward(before, skip, slot)
        at = np.arange(len(slot))
        own = p[at, cls].astype(np.float64) * q[at, inside].astype(np.float64)
        return np.log10((1 - self.shape.floor) * own + self.shape.floor * self.share[cls] * self.slot_share[cls, inside])

    def tally(self, before: np.ndarray, skip: np.ndarray, slot: np.ndarray, expected: list[np.ndarray], observed: list[np.ndarray]) -> None:
        """Add up how often each weight of the tables is expected to hold and how often it does."""
        rows, cls, inside, p, q = self.forward(before, skip, slot)
        for guess, true, tables in ((p.astype(np.float64).ravel(), cls, range(3)), (q.astype(np.float64).ravel(), inside, range(3, 5))):
            for table in tables:
                width = expected[table].shape[1]
                first = rows[table] * width
                np.add.at(expected[table].reshape(-1), (first[:, None] + np.arange(width)).ravel(), guess)
                np.add.at(observed[table].reshape(-1), first + true, 1.0)

    def update(self, expected: list[np.ndarray], observed: list[np.ndarray]) -> None:
        """One step of iterative scaling: each weight moves by the log ratio of its two counts, both with the prior.

        Three tables choose a class and two a word, so a step is at most a third or a half of the
        ratio. Such steps never overshoot, however often a context is used or however rare a word is.
        """
        for table, e, o, most in zip(self.tables, expected, observed, (3, 3, 3, 2, 2)):
            step = min(self.shape.rate, 1 / most)
            table += (step * np.log((o + self.shape.prior) / (e + self.shape.prior))).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    """The shares of each row, in place; rows are shifted to their maximum only where exp or their sum could leave its range."""
    if logits.min(initial=0) < -SAFE or logits.max(initial=0) > SAFE:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= np.einsum("ij->i", logits)[:, None]
    return logits


def _steps(sequences: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, lengths, tokens and their two contexts, some whole texts at a time, a longer text in pieces."""
    rows, lengths, parts, held = [], [], [], 0
    for row, tokens in sequences:
        context = np.concatenate([[BEGIN, BEGIN], tokens]).astype(np.uint64)
        for low in range(0, len(tokens), TOKENS_PER_STEP):
            high = min(low + TOKENS_PER_STEP, len(tokens))
            rows.append(row)
            lengths.append(high - low)
            parts.append((tokens[low:high], context[low + 1 : high + 1], context[low:high]))
            held += high - low
            if held >= TOKENS_PER_STEP:
                yield rows, lengths, *(np.concatenate(x) for x in zip(*parts))
                rows, lengths, parts, held = [], [], [], 0
    if held:
        yield rows, lengths, *(np.concatenate(x) for x in zip(*parts))


def _tallies(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        expected = [np.zeros(t.shape, np.float64) for t in model.tables]
        observed = [np.zeros(t.shape, np.float64) for t in model.tables]
        any_token = False
        for batch in batches:
            for _, _, tokens, before, skip in _steps(token_sequences(batch.column("text"))):
                model.tally(before, skip, model.slots(tokens), expected, observed)
                any_token = True
        if any_token:
            blocks, bodies = [], []
            for k, (e, o) in enumerate(zip(expected, observed)):
                for block, part in enumerate(np.split(np.column_stack([e, o]).astype(np.float32), BLOCKS)):
                    blocks.append(k * BLOCKS + block)
                    bodies.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(bodies, pa.binary())], ["block", "body"])

    return work


BLOCKS = 16


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the bodies of each block that this task gets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
            part = np.frombuffer(body.as_buffer(), np.float32).astype(np.float64)
            sums[block] = sums[block] + part if block in sums else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "body"]
    )


def common_tokens(counts: DataFrame, most: int, top: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens, `most` of them or fewer, and those of `top`, with their counts, ordered by token.

    Counts are tallied by their leading binary digits first; then exactly the tokens from a bound on
    go to the driver, not the best of every task.
    """
    tally = counts.groupBy(bucket(F.col("n")).alias("least")).agg(F.count(F.lit(1)).alias("tokens"))
    bound, held = None, 0
    for row in sorted(tally.collect(), key=lambda r: -r["least"]):
        held += row["tokens"]
        if held > most:
            break
        bound = row["least"]
    chosen = counts.filter(F.lit(False) if bound is None else F.col("n") >= bound).toPandas()
    chosen = pd.concat([chosen, top]).drop_duplicates("token")
    tokens, c = chosen["token"].to_numpy(np.int64).view(np.uint64), chosen["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], c[order]


def outside_mass(n: int, v: int, top: pd.DataFrame) -> int:
    """The base's mass, counts plus one, of all tokens beyond the model's words, the unknown one among them."""
    return n + v + 1 - int((top["n"] + 1).sum())


def train(texts: DataFrame, counts: DataFrame, shape: Shape) -> tuple[Model, int, int, pd.DataFrame]:
    """The model, the number of training tokens and of different ones, and the model's words with their counts.

    Every update is one job: tasks add up the two counts of every weight over their texts, equal
    blocks of them meet and are added up, and the driver takes the sums, twice the model's size.
    """
    spark = texts.sparkSession
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(shape.words).toPandas()
    outside = outside_mass(int(whole["n"]), int(whole["v"]), top)
    model = Model(shape, top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), outside)
    for turn in range(shape.rounds):
        shared = spark.sparkContext.broadcast(model)
        own = texts.filter(F.col("part") == turn).select("text")
        parts = own.mapInArrow(_tallies(shared), "block int, body binary")
        sums = parts.repartition(BLOCKS, "block").mapInArrow(_add_up, "block int, body binary").toArrow()
        expected = [np.zeros(t.shape) for t in model.tables]
        observed = [np.zeros(t.shape) for t in model.tables]
        height = shape.buckets // BLOCKS
        for block, body in zip(sums.column("block").to_pylist(), sums.column("body").to_pylist()):
            table, place = divmod(block, BLOCKS)
            part = np.frombuffer(body, np.float64).reshape(height, -1)
            expected[table][place * height : (place + 1) * height], observed[table][place * height : (place + 1) * height] = np.hsplit(part, 2)
        model.update(expected, observed)
        shared.unpersist()
    return model, int(whole["n"]), int(whole["v"]), top


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, log_known, log_inside = shared.value
        last = model.shape.classes * model.shape.slots - 1
        slot_known = model.slots(known)  # the model's words are all known
        for batch in batches:
            n_tokens = np.zeros(len(batch), np.int64)
            n_known, base, score = n_tokens.copy(), np.zeros(len(batch)), np.zeros(len(batch))
            rare_rows, rare_tokens = [], []
            for rows, lengths, tokens, before, skip in _steps(token_sequences(batch.column("text"))):
                row = np.repeat(rows, lengths)
                at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
                hit = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
                slot = np.full(len(tokens), last)
                slot[hit] = slot_known[at[hit]]
                n_tokens += np.bincount(row, minlength=len(batch))
                n_known += np.bincount(row[hit], minlength=len(batch))
                base += np.bincount(row[hit], log_known[at[hit]], len(batch))
                inside = np.zeros(len(tokens))
                inside[hit] = np.where(slot[hit] == last, log_inside[at[hit]], 0.0)
                score += np.bincount(row, model.log10(before, skip, slot) + inside, len(batch))
                rare_rows.append(row[~hit])
                rare_tokens.append(tokens[~hit])
            empty = np.zeros(0, np.int64)
            rare_row = np.concatenate([*rare_rows, empty]).astype(np.int64)
            rare_token = np.concatenate([*rare_tokens, empty.view(np.uint64)]).astype(np.uint64)
            order = np.lexsort((rare_token, rare_row))
            rare_row, rare_token = rare_row[order], rare_token[order]
            fresh = np.r_[True, (rare_row[1:] != rare_row[:-1]) | (rare_token[1:] != rare_token[:-1])][: len(rare_row)]
            heads = np.flatnonzero(fresh)
            times = np.diff(np.r_[heads, len(rare_row)])
            take = np.concatenate([np.arange(len(batch)), rare_row[heads]])
            spread = mix(np.arange(len(batch), dtype=np.uint64) + np.uint64(7))
            zeros, ones = np.zeros(len(heads)), np.ones(len(batch), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(pa.array(take)) for k in KEY),
                    pa.array(np.concatenate([spread, rare_token[heads]]).view(np.int64)),
                    pa.array(np.r_[np.zeros(len(batch), bool), np.ones(len(heads), bool)]),
                    pa.array(np.concatenate([ones, times]).astype(np.int64)),
                    pa.array(np.concatenate([n_tokens, zeros.astype(np.int64)])),
                    pa.array(np.concatenate([n_known, zeros.astype(np.int64)])),
                    pa.array(np.concatenate([base, zeros])),
                    pa.array(np.concatenate([score, zeros])),
                ],
                [*KEY, "token", "rare", "times", "n_tokens", "n_known", "base", "score"],
            )

    return work


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of `docs` (doc_id, text).

    Tokens are the lower-cased words and one end, known by a 64-bit hash. Counts of all training
    tokens are added up per task before their shuffle. base_score is the smoothed unigram log10
    probability. score is that of a maximum-entropy model: P(class | context) * P(word | class,
    context), features of the context hashed into tables of fixed size, trained by `rounds`
    updates that together see every training text once. Words outside the model's vocabulary share
    one slot, and in it have their smoothed unigram probability. A `floor` of the base is mixed in,
    so the model gives every sequence of tokens a proper probability, above zero for any text.

    The counts of the `broadcast_tokens` commonest tokens and the model are sent to every task,
    both of fixed size. Tokens beyond are joined to their counts, once per text and token.

    A null or empty text is the end alone. A null doc_id is learned from. Repeated rows get a row
    each; rows with equal doc_ids are told apart by their texts. Without training texts every
    token is unknown and the model is the base. A text of any length is scored in steps of
    `TOKENS_PER_STEP` tokens. An empty table gives no rows; columns beside doc_id and text are left
    alone, whatever their names. `broadcast_tokens` changes where counts are looked up, not what
    is found.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shape.rounds))
    learned = rows.filter(~held_out()).select("text", part.alias("part"))
    counts = learned.select("text").mapInArrow(_count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "token_counts")
    model, n, v, top = train(learned, counts, shape)
    outside = outside_mass(n, v, top)
    tokens, c = common_tokens(counts, shape.broadcast_tokens, top)
    table = (tokens, np.log10((c + 1) / (n + v + 1)), np.log10((c + 1) / outside))
    scored = rows.mapInArrow(
        _score(spark.sparkContext.broadcast((model, *table))),
        "doc_id bigint, text_hash bigint, token bigint, rare boolean, times bigint, n_tokens bigint, n_known bigint, base double, score double",
    )
    looked_up = scored.join(counts.withColumnRenamed("token", "counted"), (F.col("token") == F.col("counted")) & F.col("rare"), "left")
    c_one = F.coalesce("n", F.lit(0)) + 1
    texts = looked_up.groupBy(*KEY).agg(
        F.sum(F.when(~F.col("rare"), 1).otherwise(0)).cast("int").alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("common_known"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("base") + F.when(F.col("rare"), F.col("times") * F.log10(c_one / F.lit(n + v + 1))).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("rare"), F.col("times") * F.log10(c_one / F.lit(outside))).otherwise(0.0)).alias("score"),
    )
    known = F.expr("(common_known + rare_known) div copies")
    each = texts.withColumn("copy", F.explode(F.array_repeat("copies", F.col("copies"))))
    return each.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        known.alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )
