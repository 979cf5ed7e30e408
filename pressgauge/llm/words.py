"""Words and their hashes over whole Arrow string columns, for use inside Spark tasks.

All word definitions here separate at ASCII bytes only, so UTF-8 bytes can be scanned without decoding.
A word's hash is a polynomial over its bytes modulo 2**64, mixed at the end; words of more than LONG_WORD bytes are
hashed by xxh3. Exactness never rests on it where an operator promises to verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Workers live long: what Arrow frees should go back to the system, not stay in its own pool.
pa.set_memory_pool(pa.system_memory_pool())

LONG_WORD = 256
PIECE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Separators as tables over bytes: white space; everything but digits, letters and non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = np.random.default_rng(20_251_120).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = BASE if kind == "up" else INVERSE
        have = np.full(n, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[kind] = have
    return have


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each (one longer text stays whole)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where a text ends, and the first run of each text."""
    first = offsets[:-1][np.diff(offsets) > 0]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    stop = np.zeros(len(inside) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:]
    later = first[first > 0]
    stop[later] = inside[later - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offsets)


class Lookup:
    """Places of 64-bit hashes in a sorted array of distinct ones; -1 for those it lacks."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        slot = keys >> self.shift
        self.first = np.full(1 << bits, -1, np.int32)
        self.first[slot] = np.arange(len(keys), dtype=np.int32)
        self.crowded = np.bincount(slot.astype(np.int64), minlength=1 << bits) > 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        slot = hashes >> self.shift
        at = self.first[slot]
        missed = self.keys[at] != hashes
        again = np.flatnonzero(missed & self.crowded[slot])
        at[missed] = -1
        if len(again):
            place = np.minimum(np.searchsorted(self.keys, hashes[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[place] == hashes[again], place, -1)
        return at


class Words:
    """Words of some texts: byte ``starts`` and ``ends`` in ``data``, words per text, and the text's number of each."""

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool = False):
        self.data, self.offsets = text_buffers(column)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends, self.bounds = runs(~separators[self.data], self.offsets)
        self.counts = np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out = np.zeros(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
            low, high = int(starts[i]), int(ends[j - 1])
            if j == i + 1 and high - low > LONG_WORD:
                out[i] = xxhash.xxh3_64_intdigest(self.data[low:high].tobytes())
                i = j
                continue
            at = starts[i:j] - low
            length = ends[i:j] - starts[i:j]
            values = _VALUES[self.data[low:high]]
            values *= powers("up", PIECE + LONG_WORD)[: high - low]
            sums = np.add.reduceat(values, np.column_stack([at, at + length]).ravel()[:-1])[::2]
            sums *= powers("down", PIECE + LONG_WORD)[at]
            out[i:j] = mix(sums)
            for k in np.flatnonzero(length > LONG_WORD):
                out[i + k] = xxhash.xxh3_64_intdigest(self.data[starts[i + k] : ends[i + k]].tobytes())
            i = j
        return out

    def joined(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` (exclusive) with a space between."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last]))

    def points(self, text: int) -> np.ndarray:
        """Code points before each byte of one text."""
        low, high = self.offsets[text], self.offsets[text + 1]
        heads = (self.data[low:high] & 0xC0) != 0x80
        return np.concatenate([[0], np.cumsum(heads)])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, one for each start (runs over text ends included)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out *= BASE
        out += hashes[k : k + last]
    return mix(out)


def within(words: Words, n: int) -> np.ndarray:
    """Which starts of ``grams`` have their whole run in one text."""
    left = np.repeat(words.bounds[1:], words.counts) - np.arange(len(words.starts))
    return left[: max(0, len(left) - n + 1)] >= n
