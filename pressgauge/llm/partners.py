"""Which ids of a tile have a partner there: another id of the tile whose size and bit map allow the similarity.

Most ids that share a tile are not alike, and their bit maps show it. ``partnered`` finds those before anything is made of
their tiles: rows with their bit maps are dealt by tile once, packed, in turns of TURN bands, so the disk holds the rows of
one turn; a task sorts what it got, compares, and gives the (tile, id) of ids with a partner. No pairs are written, and no
linked pair is lost, as both its ids have a partner.

A tile's ids are sorted by size. Each is compared with the NEAR next ones; after that, those still without a partner are
compared with all of a size that the similarity allows, so many ids that are all alike need few comparisons. Tiles of more
than LARGE ids are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import stored
from .sketches import _fold, close, map_bits

TURN = 3  # bands dealt at a time
PACKED = 1 << 15  # rows packed together
NEAR = 16
LARGE = 1 << 17
WORDS = 1 << 18  # 64-bit words of maps compared at a time


def partnered(rows: DataFrame, bands: list[str], percent: int, spread: int, partitions: int) -> list[DataFrame]:
    """(tile, id) of the ids with a partner, as stored tables. ``rows``: id, n, sketch (``sketches``, of ``spread``), and columns
    of tiles; an id may have several rows. All tiles of a column differ from those of the others."""
    found = []
    for low in range(0, len(bands), TURN):
        own = bands[low : low + TURN]
        dealt = rows.select("id", "n", "sketch", *own).mapInArrow(lambda batches: _dealt(batches, partitions), "part int, tiles binary, ids binary, n binary, maps binary")
        near = dealt.repartitionById(partitions, "part").mapInArrow(lambda batches: _partners(batches, percent, spread), "tile long, id long")
        found.append(stored(near, "partners", tidy=True))
    return found


def _dealt(batches, parts: int):
    rest, n = [], 0
    for batch in batches:
        rest.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield _packed(pa.Table.from_batches(rest), parts)
            rest, n = [], 0
    if n:
        yield _packed(pa.Table.from_batches(rest), parts)


def _packed(table: pa.Table, parts: int) -> pa.RecordBatch:
    """One row for each part of the hash space: its tiles, ids, sizes and maps, one after another."""
    bands = table.num_columns - 3
    tiles = np.concatenate([table.column(3 + k).to_numpy() for k in range(bands)])
    part = (((tiles.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    bounds, line = np.append(edges, len(order)), order % table.num_rows
    maps = table.column(2).combine_chunks().take(pa.array(line))
    places = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1]
    columns = [_binary(x[i], bounds * x.itemsize) for x, i in ((tiles, order), (table.column(0).to_numpy(), line), (table.column(1).to_numpy().astype(np.int32), line))]
    columns.append(pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(places[bounds].astype(np.int32)), maps.buffers()[2]]))
    return pa.RecordBatch.from_arrays([pa.array(part[order][edges]), *columns], names=["part", "tiles", "ids", "n", "maps"])


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array) -> np.ndarray:
    """What the binaries of a column hold, one after another."""
    if not len(column):
        return np.zeros(0, np.uint8)
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[places[0] : places[-1]]


def _partners(batches, percent: int, spread: int):
    parts = [[_bytes(batch.column(k)).copy() for k in range(1, 5)] for batch in batches]
    if not parts:
        return
    tiles, ids, n, maps = (np.concatenate([p[k] for p in parts]) for k in range(4))
    del parts
    tiles, ids, n = tiles.view(np.int64), ids.view(np.int64), n.view(np.int32)
    sizes = map_bits(n, spread) // 8
    starts = np.cumsum(sizes) - sizes
    rows = np.argsort(tiles, kind="stable")
    rows = rows[_shared(tiles[rows])]
    rows = rows[np.lexsort((ids[rows], tiles[rows]))]
    rows = rows[np.append(True, (np.diff(tiles[rows]) != 0) | (np.diff(ids[rows]) != 0))[: len(rows)]]
    rows = rows[_shared(tiles[rows])]
    rows = rows[np.lexsort((n[rows], tiles[rows]))]
    kept = rows[with_partner(tiles[rows], n[rows].astype(np.int64), sizes[rows], starts[rows], maps, percent)]
    yield pa.RecordBatch.from_arrays([pa.array(tiles[kept]), pa.array(ids[kept])], names=["tile", "id"])


def _shared(tiles: np.ndarray) -> np.ndarray:
    """Which of sorted tiles occur more than once."""
    same = tiles[1:] == tiles[:-1]
    return np.append(same, False)[: len(tiles)] | np.append(False, same)[: len(tiles)]


def with_partner(tiles: np.ndarray, n: np.ndarray, sizes: np.ndarray, starts: np.ndarray, maps: np.ndarray, percent: int) -> np.ndarray:
    """Whether each row has a partner in its tile. Rows are sorted by tile and n; their maps are so many bytes from ``starts``."""
    found = np.zeros(len(tiles), bool)
    if not len(tiles):
        return found
    heads = np.flatnonzero(np.append(True, np.diff(tiles) != 0))
    lengths = np.diff(np.append(heads, len(tiles)))
    head, tail = np.repeat(heads, lengths), np.repeat(heads + lengths, lengths)
    # sorted by tile, then n, each row sees the sizes that it allows as one run of rows
    top = n.max() + 2
    places = np.repeat(np.arange(len(heads)), lengths) * top
    first = np.maximum(head, np.searchsorted(places + n, places - (-n * percent // 100)))
    last = np.minimum(tail, np.searchsorted(places + n, places + np.minimum(n * 100 // percent, top - 1), "right"))
    at = np.arange(len(tiles))
    level = [(size, _level(size, sizes, starts, maps)) for size in np.unique(sizes).tolist()]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Rows i with later rows j of the same tile."""
        for size, (place, words) in level:
            pairs = np.flatnonzero(sizes[i] == size)
            step = max(1, WORDS // words.shape[1])
            for low in range(0, len(pairs), step):
                x, y = i[pairs[low : low + step]], j[pairs[low : low + step]]
                bits = np.bitwise_count(words[place[x]] ^ words[place[y]]).sum(1, dtype=np.int64)
                near = close(n[x], n[y], bits, percent)
                found[x[near]] = True
                found[y[near]] = True

    large = tail - head > LARGE
    found[large] = True
    for low in range(0, len(at), WORDS // NEAR):
        some = at[low : low + WORDS // NEAR]
        some = some[~large[some]]
        compare(*_runs(some, some + 1, np.minimum(last[some], some + 1 + NEAR)))
    # those left look at all others before them that are found, and at all after them
    low = 0
    todo = np.flatnonzero(~found)
    reach = np.cumsum(last[todo] - first[todo])
    while low < len(todo):
        high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + WORDS, "right")))
        some = todo[low:high]
        some = some[~found[some]]
        known = np.flatnonzero(found)
        j, i = _runs(some, np.searchsorted(known, first[some]), np.searchsorted(known, some))
        compare(known[i], j)
        compare(*_runs(some, np.minimum(some + 1 + NEAR, last[some]), last[some]))
        low = high
    return found


def _runs(rows: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with each number from its low to below its high."""
    many = np.maximum(0, highs - lows)
    return np.repeat(rows, many), np.arange(many.sum()) + np.repeat(lows - np.cumsum(many) + many, many)


def _level(size: int, sizes: np.ndarray, starts: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of ``size`` bytes and longer ones folded to it, as rows of 64-bit words; and each row's place among them.

    A similar set has a map of at most twice the bytes, as sizes differ by less than that."""
    place, out = np.zeros(len(sizes), np.int64), []
    done = 0
    for length in (size, 2 * size):
        those = np.flatnonzero(sizes == length)
        if not len(those):
            continue
        place[those] = done + np.arange(len(those))
        done += len(those)
        out.append(_fold(np.lib.stride_tricks.sliding_window_view(maps, length)[starts[those]], size))
    return place, np.ascontiguousarray(np.concatenate(out)).view(np.uint64)
