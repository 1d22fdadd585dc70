"""Periodic runs of words, found by an online catcher of squares."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.textops import Powers, mix

WORDS_PER_APPEND = 8192
FIRST_STEP = 16
_POWERS = Powers(0x9E3779B97F4A7C15 | 3)

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RESULT = {
    "n_words": T.LongType(),
    "runs": T.ArrayType(RUN, False),
    "collapsed": T.StringType(),
}


class SquareCatcher:
    """All runs of a growing word sequence whose length is at least `powers` (4 or more) periods.

    The words completed so far form blocks of 2^k words at every level k. The catcher of a block
    that starts at s waits for squares with a period p from 2^k to 2^(k+1) - 1: it fires when the
    words from s and those from s + p agree over 2^(k+1) words, which is more than p, so the
    stretch is a square. Any run of 4 periods has a block so placed that all this lies inside
    it, hence no run is missed. Only one block stands at the right distance before any place,
    so appending a word costs one comparison of suffix hashes a level.

    A catch is confirmed word by word, grown to both sides and kept as a stretch; stretches that
    reach the end of the sequence grow on with the words appended next. A later catch inside a
    stretch belongs to it: by the periodicity lemma its period is a multiple. So each run is
    grown once, and its period is its smallest.
    """

    def __init__(self, powers: int = 4):
        if powers < 4:
            raise ValueError("blocks catch runs of 4 periods or more")
        self.powers = powers
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.stretches: list[list[int]] = []  # start, end, period
        self.open: list[list[int]] = []

    def append(self, words: np.ndarray) -> None:
        """Words are numbers; equal numbers are equal words."""
        if not len(words):
            return
        before = len(self.words)
        up, down = _POWERS.upto(before + len(words) + 1)
        values = mix(words.astype(np.uint64) + np.uint64(1)) * up[before:-1]
        self.words = np.concatenate([self.words, words])
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(values, dtype=np.uint64)])
        for stretch in self.open:
            stretch[1] = self._forward(stretch[1], stretch[2])
        self.open = [s for s in self.open if s[1] == len(self.words)]
        level = 0
        while self.powers << level <= len(self.words):
            self._catch(level, before, down)
            level += 1

    def _catch(self, level: int, before: int, down: np.ndarray) -> None:
        """The squares of one level whose compared words were completed by the last append."""
        width = 2 << level
        at = np.arange(max(before - width + 1, 1 << level), len(self.words) - width + 1)
        if not len(at):
            return
        block = ((at >> level) - 1) << level
        ours = (self.sums[at + width] - self.sums[at]) * down[at]
        blocks = (self.sums[block + width] - self.sums[block]) * down[block]
        hits = np.flatnonzero(ours == blocks)
        if not len(hits):
            return
        starts, reach = self._reach(width)
        grown: dict[int, int] = {}
        for s, j in zip(block[hits].tolist(), at[hits].tolist()):
            known = bisect_right(starts, s)
            if known and reach[known - 1] >= j + width or grown.get(j - s, 0) >= j + width:
                continue
            if np.array_equal(self.words[s : s + width], self.words[j : j + width]):
                stretch = [self._backward(s, j - s), self._forward(j + width, j - s), j - s]
                grown[j - s] = stretch[1]
                self.stretches.append(stretch)
                if stretch[1] == len(self.words):
                    self.open.append(stretch)

    def _reach(self, below: int) -> tuple[list[int], list[int]]:
        """Starts of the stretches with periods below that, in order, and how far any up to there reaches."""
        known = sorted((s[0], s[1]) for s in self.stretches if s[2] < below)
        ends = np.maximum.accumulate(np.array([e for _, e in known], np.int64)).tolist() if known else []
        return [s for s, _ in known], ends

    def _forward(self, end: int, period: int) -> int:
        """Move the end on while words a period apart agree."""
        step = FIRST_STEP
        while end < len(self.words):
            a, b = self.words[end : end + step], self.words[end - period : end - period + step]
            differ = np.flatnonzero(a != b[: len(a)])
            if len(differ):
                return end + int(differ[0])
            end, step = end + len(a), 2 * step
        return end

    def _backward(self, start: int, period: int) -> int:
        step = FIRST_STEP
        while start > 0:
            low = max(start - step, 0)
            differ = np.flatnonzero(self.words[low:start] != self.words[low + period : start + period])
            if len(differ):
                return low + int(differ[-1]) + 1
            start, step = low, 2 * step
        return start

    def runs(self, least: int = 6) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of `least` words at least, by start, then period."""
        found = ((a, b - a, p) for a, b, p in self.stretches if b - a >= max(least, self.powers * p))
        return sorted(found)


def runs_of(words: list[bytes], least: int, powers: int) -> list[tuple[int, int, int]]:
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    catcher = SquareCatcher(powers)
    for i in range(0, len(ids), WORDS_PER_APPEND):
        catcher.append(ids[i : i + WORDS_PER_APPEND])
    return catcher.runs(least)


def _work(least: int, powers: int):
    run_type = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, collapsed = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                runs = runs_of(words, least, powers)
                n_words.append(len(words))
                found.append([dict(zip(RUN.names, r)) for r in runs])
                if runs:
                    kept = np.ones(len(words), bool)
                    for start, length, period in runs:
                        kept[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(kept).tolist()]
                collapsed.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), pa.array(n_words, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.string())],
                ["rest", *RESULT],
            )

    return work


def find_runs(docs: DataFrame, least: int = 6, powers: int = 4) -> DataFrame:
    """`rest` (all columns but text), n_words, runs and collapsed for every row of `docs`.

    A run is a stretch of words with smallest period q (words q apart are equal) of at least
    max(`least`, `powers` * q) words that no neighbouring word extends. `runs` holds start (from
    0), length and period of each, by start, then period. `collapsed` is the text without the
    words that some run contains after its first q words; kept words are joined by one space.

    Words are separated by blanks and the control characters 09 to 0D. Each text is a stream of
    its own, handed to a `SquareCatcher` in steps, so there is no shuffle, and memory is that of
    one text with a few numbers a word, however long it is.

    A null or empty text has no words, no runs and an empty `collapsed`. Rows are judged one by
    one, so repeated rows, null ids and an empty table need no rule; the operator's names may
    also be names of columns of `docs`, which are kept inside `rest`.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(rest, "text")
    schema = T.StructType([rows.schema["rest"], *(T.StructField(n, t) for n, t in RESULT.items())])
    return rows.mapInArrow(_work(least, powers), schema)
