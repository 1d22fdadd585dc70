"""Byte-level BPE: texts to token ids by a vocabulary of merge ranks, and ids back to bytes."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.textops import chunks

CHUNK_BYTES = 8 << 20
# Longer pieces go through the rank queue, shorter ones through a plain loop that gives the same ids.
LONG_PIECE = 64
NONE = -1


class RankBitmap:
    """A set of ranks as three levels of 64-bit words; the smallest is found by three find-first-sets."""

    __slots__ = ("low", "middle", "top")

    def __init__(self) -> None:
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def add(self, rank: int) -> None:
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[block] = self.middle.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def smallest(self) -> int:
        """The smallest rank of the set, which must not be empty."""
        top, middle, low = self.top, self.middle, self.low
        block = (top & -top).bit_length() - 1
        bits = middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def discard(self, rank: int) -> None:
        word, block = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[block] &= ~(1 << (word & 63))
            if not self.middle[block]:
                self.top &= ~(1 << block)


class Vocabulary:
    """Token bytes by rank, and for every pair of tokens that makes a token its rank."""

    def __init__(self, lines: bytes):
        self.rank: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        tokens = {r: t for t, r in self.rank.items()}
        size = max(tokens) + 1
        lengths = np.zeros(size, np.int64)
        for r, t in tokens.items():
            lengths[r] = len(t)
        self.token_ends = np.cumsum(lengths)
        self.token_starts = self.token_ends - lengths
        self.token_bytes = np.frombuffer(b"".join([tokens.get(r, b"") for r in range(size)]), np.uint8)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they make no token."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens end to end, and how many each has.

        A pre-token that is a token is that token. Else always the pair of lowest rank merges,
        the leftmost first. Long pre-tokens are merged one by one, all others side by side.
        """
        encoded: list[np.ndarray | None] = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            rank = self.rank.get(piece)
            if rank is not None:
                encoded[k] = np.array([rank])
            elif len(piece) > LONG_PIECE:
                encoded[k] = np.array(self.encode_long(piece), np.int64)
            else:
                rest.append(k)
        if rest:
            ids, counts = self._merge_together([pieces[k] for k in rest])
            for k, own in zip(rest, np.split(ids, np.cumsum(counts)[:-1])):
                encoded[k] = own
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.concatenate([*encoded, np.zeros(0, np.int64)]).astype(np.int64), lengths

    def _merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The rank queue over many short pre-tokens at once.

        Their bytes form one linked list with gaps between pre-tokens; a bucket is opened for all
        of them, and each merges its leftmost position of that rank. Its other positions go
        back to the bucket, so a lower rank that has come up meanwhile is served first.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, owner = int(lengths.sum()), np.repeat(np.arange(len(pieces)), lengths)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        following[ends - 1] = NONE
        before[ends - lengths] = NONE
        alive = np.ones(n, bool)
        current = np.full(n, NONE)
        inner = np.flatnonzero(following != NONE)
        current[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        ranks = RankBitmap()

        def push(positions: np.ndarray) -> None:
            found = current[positions]
            positions, found = positions[found != NONE], found[found != NONE]
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(found)]
            for low, high in zip(bounds, bounds[1:]):
                if high > low:
                    rank = int(found[low])
                    if rank in buckets:
                        buckets[rank].append(positions[low:high])
                    else:
                        buckets[rank] = [positions[low:high]]
                        ranks.add(rank)

        push(inner)
        while ranks.top:
            rank = ranks.smallest()
            ranks.discard(rank)
            opened = buckets.pop(rank)
            positions = opened[0] if len(opened) == 1 else np.unique(np.concatenate(opened))
            positions = positions[current[positions] == rank]
            if not len(positions):
                continue
            whose = owner[positions]
            leftmost = np.ones(len(positions), bool)
            leftmost[1:] = whose[1:] != whose[:-1]
            if not leftmost.all():
                buckets[rank] = [positions[~leftmost]]
                ranks.add(rank)
                positions = positions[leftmost]
            second = following[positions]
            after = following[second]
            ids[positions] = rank
            following[positions] = after
            alive[second] = False
            current[second] = NONE
            current[positions] = NONE
            more = after != NONE
            with_after, after = positions[more], after[more]
            before[after] = with_after
            left = before[positions]
            left = left[left != NONE]
            at = np.concatenate([left, with_after])
            current[at] = self.ranks_of(ids[at], ids[following[at]])
            push(at)
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
        return ids[alive], counts

    def encode_long(self, piece: bytes) -> list[int]:
        """The rank queue over one pre-token.

        The tokens are a linked list over the byte positions. Each rank has a bucket of the
        positions whose pair had that rank when it was formed; the bitmap tells the lowest rank
        with a bucket. A position whose pair has changed since is stale and skipped. A bucket is
        sorted when it is opened, and what a merge adds at or below the rank at hand goes first.
        A piece of n bytes takes O(n log n) steps.
        """
        n, pair = len(piece), self.pair
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        current = [NONE] * n
        buckets: dict[int, list[int]] = {}
        ranks = RankBitmap()

        def push(rank: int, positions: list[int]) -> None:
            if rank in buckets:
                buckets[rank].extend(positions)
            else:
                buckets[rank] = positions
                ranks.add(rank)

        for i in range(n - 1):
            current[i] = pair.get(ids[i] << 32 | ids[i + 1], NONE)
            if current[i] != NONE:
                push(current[i], [i])
        while ranks.top:
            rank = ranks.smallest()
            positions = sorted(buckets.pop(rank))
            ranks.discard(rank)
            for k, i in enumerate(positions):
                if current[i] != rank:
                    continue
                second = following[i]
                after = following[second]
                ids[i], following[i], current[second] = rank, after, NONE
                if after < n:
                    before[after] = i
                lowest = rank + 1
                for place in (before[i], i):
                    if place >= 0:
                        beside = following[place]
                        current[place] = pair.get(ids[place] << 32 | ids[beside], NONE) if beside < n else NONE
                        if current[place] != NONE:
                            push(current[place], [place])
                            lowest = min(lowest, current[place])
                if lowest <= rank and k + 1 < len(positions):
                    push(rank, positions[k + 1 :])
                    break
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens end to end, and how many each has."""
        return gather(self.token_bytes, self.token_starts[ids], self.token_ends[ids] - self.token_starts[ids])


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:start + length] of all pairs end to end, and the lengths."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + shift], lengths


def encode_together(
    texts: list[str], vocabulary: Vocabulary, split: Callable[[str], list[str]]
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and how many each has. Each different pre-token is encoded once."""
    number: dict[str, int] = {}
    pieces = []
    for text in texts:
        own = split(text)
        pieces.append(np.array([number.setdefault(p, len(number)) for p in own], np.int64))
    ids, lengths = vocabulary.encode_pieces([p.encode() for p in number])
    starts = np.cumsum(lengths) - lengths
    per_text = np.fromiter((int(lengths[p].sum()) for p in pieces), np.int64, len(pieces))
    order = np.concatenate([*pieces, np.zeros(0, np.int64)])
    return gather(ids, starts[order], lengths[order])[0], per_text


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(lines: bytes) -> Vocabulary:
    key = hash(lines)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(lines)
    return _vocabularies[key]


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _encode(lines: Broadcast, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = _vocabulary(lines.value), regex.compile(pattern).findall
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(chunk.first_row, len(chunk))
                texts = [chunk.text(i).decode() for i in range(len(chunk))]
                ids, per_text = encode_together(texts, vocabulary, split)
                token_at = _offsets(per_text)
                decoded, per_token = vocabulary.decode(ids)
                byte_at = _offsets(per_token)[token_at]
                tokens = pa.ListArray.from_arrays(
                    pa.array(token_at, pa.int32()), pa.array(ids.astype(np.int32))
                )
                whole = pa.Array.from_buffers(
                    pa.binary(), len(part), [None, pa.py_buffer(byte_at.astype(np.int32)), pa.py_buffer(decoded)]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), part.column("text"), tokens, whole], ["rest", "text", "ids", "decoded"]
                )

    return work


def encode_texts(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """`rest` (all columns but text), text, ids and decoded (the ids' bytes) for every row of `docs`.

    Each text is cut by `pattern` and each piece encoded on its own by the ranks of the
    vocabulary file (base64 token and rank per line), without special tokens. The file is read
    by the driver and sent once to each executor; its size is that of the vocabulary. Memory
    is that of a piece of a batch, or of the longest text.

    A null or empty text has no ids. Rows are independent: repeated rows, null ids and extra
    columns of any name pass through inside `rest`. An empty table gives no rows. No shuffle.
    """
    with open(vocabulary_path, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("rest"), "text")
    schema = T.StructType(
        [
            rows.schema["rest"], rows.schema["text"],
            T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(_encode(lines, pattern), schema)
