"""Words, rolling hashes and runs over many texts at once, as numpy arrays over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# White space of the word rule: blank and the five control characters 09-0D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
CHUNK_BYTES = 1 << 20
WORD_BYTES = 1 << 16
ROWS_OUT = 500

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 62, 2, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15 | 3, 0xD1342543DE82EF95 | 3)

IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up = self._powers(self.base, size)
            self.down = self._powers(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_POWERS = tuple(Powers(b) for b in _BASES)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal spans have equal hashes."""
    up, down = _POWERS[which].upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], none of them empty: the sum of a mixed value per byte and place.

    Unlike a polynomial modulo 2^64, which some pairs of long periodic words defeat for any base,
    a byte's value depends on its place in no regular way. Works on `WORD_BYTES` at a time, or on
    one longer word.
    """
    lengths = ends - starts
    upto = np.cumsum(lengths)
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        done = int(upto[low - 1]) if low else 0
        high = max(int(np.searchsorted(upto, done + WORD_BYTES, "right")), low + 1)
        size = lengths[low:high]
        first = upto[low:high] - size - done
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        values = data[np.repeat(starts[low:high], size) + place].astype(np.uint64)
        values |= place.astype(np.uint64) << np.uint64(8)
        values += _SEEDS[which]
        out[low:high] = np.add.reduceat(mix(values), first) + _SEEDS[which]
        low = high
    return mix(out)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


class Chunk:
    """Some whole texts laid end to end: text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row = data, offsets, first_row

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of the first word of each text (and of the end)."""
        inside = is_word[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        before = np.empty(len(inside), bool)
        after = np.empty(len(inside), bool)
        before[:1], after[-1:] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (cut[:-1] | ~before))
        ends = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """Cut a string column into pieces of whole texts of about `chunk_bytes`; a null is an empty text.

    A longer text is a piece of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = texts.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, large.offset * 8)
    body = large.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(large):
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1
        end = min(max(end, row + 1), len(large))
        piece = data[offsets[row] : offsets[end]]
        yield Chunk(LOWER[piece] if lower else piece, offsets[row : end + 1] - offsets[row], row)
        row = end


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few, for work that returns texts: a batch's results are held whole."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    low, done = values, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


def minimizers(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `width` values its minimum, and the places that hold one of these minima.

    Both depend on the window's values alone, so equal windows choose equal places.
    """
    low = sliding_min(values, width)
    if not len(low):
        return low, np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(width - 1, low.dtype), low, np.zeros(width - 1, low.dtype)])
    highest = ~sliding_min(~padded, width)  # the highest of the minima of the windows over a place
    return low, np.flatnonzero(highest == values)


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Mask of the places in any of the runs of `width` places that begin at `starts`."""
    edges = np.zeros(length + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, length), -1)
    return np.cumsum(edges[:-1]) > 0
