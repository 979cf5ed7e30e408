"""Parity bit maps of sets of 64-bit hashes: sets that differ in d members differ in at most d bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST, MOST, SPREAD = 64, 1 << 15, 4
PLACES = 1 << 22  # bits of maps made at a time


def sketch(members: np.ndarray, spread: int = SPREAD) -> bytes:
    """Of ``spread`` or more bits for each member (a power of two, LEAST to MOST)."""
    bits = min(MOST, max(LEAST, 1 << max(0, spread * len(members) - 1).bit_length()))
    return np.packbits((np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def map_bits(n: np.ndarray, spread: int) -> np.ndarray:
    """Bits of the maps of sets of so many members."""
    return np.clip(1 << np.frexp(np.maximum(spread * n.astype(np.int64) - 1, 0))[1].astype(np.int64), LEAST, MOST)


def sketches(members: np.ndarray, bounds: np.ndarray, spread: int = SPREAD) -> list[bytes]:
    """``sketch`` of many sets, which lie one after another. Fewer bits a member keep the bound, and let more pairs pass it."""
    n, out = np.diff(bounds), np.empty(len(bounds) - 1, object)
    sizes = map_bits(n, spread)
    for bits in np.unique(sizes).tolist():
        those = np.flatnonzero(sizes == bits)
        for part in np.array_split(those, -(-len(those) * bits // PLACES)):
            place = np.repeat(np.arange(len(part)) * bits, n[part])
            place += (members[np.arange(len(place)) + np.repeat(bounds[part] - np.cumsum(n[part]) + n[part], n[part])] % np.uint64(bits)).astype(np.int64)
            maps = np.packbits((np.bincount(place, minlength=len(part) * bits) & 1).astype(bool)).tobytes()
            out[part] = [maps[i * bits // 8 : (i + 1) * bits // 8] for i in range(len(part))]
    return out.tolist()


def close(n, m, bits, percent: int):
    """Whether sets of n and m members whose maps differ in so many bits can be ``percent`` similar.

    A similarity of p / 100 leaves at most (n + m) (100 - p) / (100 + p) members in one of the sets only.
    """
    return (100 + percent) * bits <= (100 - percent) * (n + m)


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The map of half as many bits, again and again: members meet those whose places agree in the lower bits."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())


def _matrix(sketches: np.ndarray, size: int) -> np.ndarray:
    """Maps as rows of 64-bit words, folded to ``size`` bytes."""
    rows, lengths = np.empty((len(sketches), size), np.uint8), np.fromiter(map(len, sketches), np.int64, len(sketches))
    for n in np.unique(lengths):
        those = np.flatnonzero(lengths == n)
        rows[those] = _fold(np.frombuffer(b"".join(sketches[those]), np.uint8).reshape(len(those), -1), size)
    return rows.view(np.uint64)


def differing(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the maps of many pairs differ, each pair's folded to the smaller of its two."""
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    shorter, out = np.minimum(lengths[i], lengths[j]), np.zeros(len(i), np.int64)
    for size in np.unique(shorter).tolist():
        pairs = np.flatnonzero(shorter == size)
        used, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        maps, a, b = _matrix(sketches[used], size), at[: len(pairs)], at[len(pairs) :]
        step = max(1, (1 << 20) // size)
        for low in range(0, len(pairs), step):
            x, y = a[low : low + step], b[low : low + step]
            out[pairs[low : low + step]] = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
    return out


def plausible_pairs(rows: dict, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``plausible``, of given pairs of rows."""
    n, m = rows["n"][i], rows["n"][j]
    near = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    i, j, n, m = i[near], j[near], n[near], m[near]
    bits = differing(rows["sketch"], i, j)
    near = close(n, m, bits, percent)
    return i[near], j[near], bits[near] / (n + m)[near]


def plausible(left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two blocks (columns n and sketch) whose sizes and maps allow the similarity, and their distances.

    Of a block with itself each pair is given once. Maps of one length are compared with those of another at a time: folded
    to the shortest of the block, nearly all would pass.
    """
    rows, columns, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    own, others = _by_length(left["sketch"]), _by_length(right["sketch"])
    for x, those in own.items():
        for y, with_these in others.items():
            n, m = left["n"][those], right["n"][with_these]
            if right is left and y < x or 100 * min(n.max(), m.max()) < percent * max(n.min(), m.min()):
                continue
            a = _matrix(left["sketch"][those], min(x, y))
            b = a if right is left and x == y else _matrix(right["sketch"][with_these], min(x, y))
            step = max(1, (1 << 18) // (len(b) * b.shape[1]))  # rows at a time
            for low in range(0, len(a), step):
                some = n[low : low + step, None]
                bits = np.bitwise_count(a[low : low + step, None] ^ b[None]).sum(2, dtype=np.int64)
                near = (100 * np.minimum(some, m) >= percent * np.maximum(some, m)) & close(some, m, bits, percent)
                if b is a:
                    near &= np.arange(low, low + len(some))[:, None] < np.arange(len(b))
                i, j = np.nonzero(near)
                rows.append(those[i + low])
                columns.append(with_these[j])
                far.append(bits[i, j] / (n[i + low] + m[j]))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(far)


def _by_length(maps: np.ndarray) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, maps), np.int64, len(maps))
    return {size: np.flatnonzero(lengths == size) for size in np.unique(lengths).tolist()}


def side(table: DataFrame, x: str) -> DataFrame:
    """``table`` by id, its columns renamed for one end of a pair."""
    return table.select(F.col("id").alias(x), *[F.col(c).alias(f"{c} {x}") for c in table.columns if c != "id"])


def bounded(pairs: DataFrame, attributes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose maps allow the similarity; ``attributes``: id, n, sketch."""

    def allowed(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            maps, at = np.array([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()], object), np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(close(n, m, differing(maps, at, at + len(at)), percent), pa.bool_()))

    both = pairs.join(side(attributes, "a"), "a").join(side(attributes, "b"), "b")
    return both.select("a", "b", "n a", "n b", "sketch a", "sketch b").mapInArrow(allowed, "a long, b long")
