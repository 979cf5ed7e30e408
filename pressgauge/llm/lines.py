"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact verification, union-find.

Lines are separated by line feeds. A line's shingles are its distinct runs of SHINGLE code points in lower case. Lines
whose shingles have a Jaccard similarity of PERCENT or more are linked, equal lines without more ado; of each connected
component the first line stays, by key of the text, then by row and line number. BANDS bands of ROWS minima make linked
lines candidates with a probability of at least 1 - (1 - 0.8 ** ROWS) ** BANDS = 99.9 %; every candidate is verified.

With ``short``, lines of fewer than SHINGLE code points have their whole text, in lower case, as their only shingle, so that
repeats of them link; without it they always stay. Short lines of white space only always stay. Null texts have no lines and stay null; an empty
table gives an empty one; repeated rows are texts of their own, so the first of them keeps its lines: rows are told apart
by ``frames.numbered``. Texts and lines may be of any length.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import resolve
from .frames import bucketed, discard, free_name, numbered, stored
from .partners import partnered
from .quality import BITS, bit_map, bits_set, received, shipped
from .sketches import bounded, side, sketches
from .words import BASE, SPACE, mix, portions, runs, text_buffers

SHINGLE = 5
BANDS, ROWS = 13, 4
BAND = [f"band{k}" for k in range(BANDS)]
PERCENT = 80
AT_ONCE = 1 << 16  # shingles whose minima are taken at a time
SPREAD = 1  # bits of a line's map for each shingle, at least; the maps are joined and compared, so their size is the disk's

_RANDOM = np.random.default_rng(91)
_TURNS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_STEPS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Lines:
    """Lines of some texts as code points: starts, ends, which of each text, and which are compared."""

    def __init__(self, column: pa.Array, short: bool = False):
        self.data, self.offsets = text_buffers(column)
        self.low, self.high, self.bounds = runs(self.data != 10, self.offsets)  # bytes; empty lines left out
        self.heads = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.starts, self.ends = self.heads[self.low], self.heads[self.high]
        self.compared = self.ends - self.starts >= SHINGLE
        if short:
            filled = np.concatenate([[0], np.cumsum(~SPACE[self.data])])
            self.compared |= filled[self.high] > filled[self.low]
        feeds = np.concatenate([[0], np.cumsum(self.data == 10)])
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))
        self.text, self.number = text, feeds[self.low] - feeds[self.offsets[text]]

    def ids(self) -> np.ndarray:
        view = memoryview(np.ascontiguousarray(self.data))
        return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(self.low.tolist(), self.high.tolist())), np.uint64, len(self.low)).view(np.int64)

    def shingles(self, those: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of some compared lines, and where each line's begin."""
        codes, starts, ends = points_of(self.data), self.starts[those], self.ends[those]
        hashes, found = np.zeros(len(codes) + 1, np.uint64), shingle_hashes(codes)
        hashes[: len(found)] = found
        small = ends - starts < SHINGLE
        hashes[starts[small]] = whole_hashes(codes, starts[small], ends[small])  # no line's shingles start there
        n = np.maximum(1, ends - starts - SHINGLE + 1)
        bounds = np.concatenate([[0], np.cumsum(n)])
        return hashes[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], n)], bounds

    def bands(self, those: np.ndarray, shingles: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """BANDS keys for each of some compared lines, which must be in their order."""
        if not len(those):
            return np.zeros((0, BANDS), np.int64)
        members, bounds = self.shingles(those) if shingles is None else shingles
        hashes = (members >> np.uint64(32)).astype(np.uint32)
        least = np.empty((BANDS * ROWS, len(those)), np.uint32)
        low = 0
        while low < len(those):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + AT_ONCE, "right")) - 1)
            own, firsts = hashes[bounds[low] : bounds[high]], bounds[low:high] - bounds[low]
            turned = np.empty_like(own)
            for k in range(BANDS * ROWS):
                np.bitwise_xor(own, _TURNS[k], out=turned)
                np.multiply(turned, _STEPS[k], out=turned)
                np.minimum.reduceat(turned, firsts, out=least[k, low:high])
            low = high
        keys = np.zeros((BANDS, len(those)), np.uint64)
        for k in range(BANDS * ROWS):
            keys[k // ROWS] = mix(keys[k // ROWS] * np.uint64(31) + least[k] + np.uint64(k // ROWS + 1))
        return np.ascontiguousarray(keys.T).view(np.int64)


def points_of(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, A-Z and the Latin-1 capitals in lower case."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    big = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    return codes + big.astype(np.uint32) * np.uint32(32)


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A polynomial hash of each SHINGLE code points, put together from runs of 1, 2, 4, ... of them."""
    have = codes.astype(np.uint64) + np.uint64(1)
    out, size, run = None, 0, 1
    while run <= SHINGLE:
        if SHINGLE & run:
            # what there is so far covers the last ``size`` code points, this run those before them
            out = have if out is None else have[: max(0, len(have) - size)] * _power(size) + out[run:]
            size += run
        have = have[:-run] * _power(run) + have[run:] if len(have) > run else have[:0]
        run *= 2
    return mix(out[: max(0, len(codes) - SHINGLE + 1)])


def whole_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of some texts of fewer than SHINGLE code points."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE - 1):
        more = starts + k < ends
        out[more] = out[more] * BASE + codes[starts[more] + k].astype(np.uint64) + np.uint64(1)
    return mix(out)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def shingle_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each line, sorted, one line's after another's; and where each line's begin."""
    data, offsets = text_buffers(column)
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes, starts, length = points_of(data), places[:-1], np.diff(places)
    hashes, found = np.zeros(len(codes) + 1, np.uint64), shingle_hashes(codes)
    hashes[: len(found)] = found
    small = length < SHINGLE
    hashes[starts[small]] = whole_hashes(codes, starts[small], places[1:][small])  # no line's shingles start there
    n = np.where(small, np.minimum(length, 1), length - SHINGLE + 1)
    bounds = np.concatenate([[0], np.cumsum(n)])
    return distinct(hashes[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], n)], bounds)


def distinct(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of the members of many sets, sorted set by set (in place), and where each set's begin."""
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        members[low:high].sort()
    new = np.ones(len(members), bool)
    new[1:] = members[1:] != members[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return members[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Distinct shingle hashes of each line, sorted."""
    members, bounds = shingle_runs(column)
    return [members[low:high] for low, high in zip(bounds.tolist(), bounds[1:].tolist())]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def line_rows(docs: DataFrame, key: str, text: str, row: str, short: bool = False) -> DataFrame:
    """One row for each compared line: row, key, number, id, and, where first met in a portion, n, sketch and its bands."""

    def split(batches):
        for batch in batches:
            for low, high in portions(batch.column(2)):
                lines = Lines(batch.column(2)[low:high], short)
                ids = lines.ids()
                those = np.flatnonzero(lines.compared)
                first = np.sort(np.unique(ids[those], return_index=True)[1])
                found = lines.shingles(those[first])
                keys = lines.bands(those[first], found)
                members, bounds = distinct(*found)
                place, missing = np.zeros(len(those), np.int64), np.ones(len(those), bool)
                place[first], missing[first] = np.arange(len(first)), False
                place = pa.array(place, mask=missing)
                attributes = [pa.array(np.diff(bounds)), pa.array(sketches(members, bounds, SPREAD), pa.binary()), *map(pa.array, np.ascontiguousarray(keys.T))]
                at = pa.array(lines.text[those] + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.number[those].astype(np.int32)), pa.array(ids[those]), *[x.take(place) for x in attributes]],
                    names=["row", "key", "number", "id", "n", "sketch", *BAND],
                )

    source = docs.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = f"row long, key {source.schema['key'].dataType.simpleString()}, number int, id long, n long, sketch binary"
    return source.mapInArrow(split, ", ".join([kinds, *[f"{band} long" for band in BAND]]))


def line_texts(docs: DataFrame, ids: DataFrame, text: str, short: bool, partitions: int) -> DataFrame:
    """(id, line, n, sketch) of the lines whose id is in ``ids``, in so many partitions of id; only lines that the bit map lets
    pass leave the task."""
    shared = docs.sparkSession.sparkContext.broadcast(shipped(bit_map(ids.select(F.col("id").bitwiseAND(BITS - 1).alias("at")), "at")))

    def split(batches):
        bits = received(shared.value)
        for batch in batches:
            for low, high in portions(batch.column(0)):
                lines = Lines(batch.column(0)[low:high], short)
                those = np.flatnonzero(lines.compared)
                ids, first = np.unique(lines.ids()[those], return_index=True)
                wanted = np.flatnonzero(bits_set(bits, ids & (BITS - 1)))
                found = pa.array([lines.data[lines.low[k] : lines.high[k]].tobytes().decode("utf-8", "replace") for k in those[first[wanted]]], pa.string())
                members, bounds = shingle_runs(found)
                maps = pa.array(sketches(members, bounds, SPREAD), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[wanted]), found, pa.array(np.diff(bounds)), maps], names=["id", "line", "n", "sketch"])

    rows = docs.select(text).mapInArrow(split, "id long, line string, n long, sketch binary").repartition(partitions, "id")
    return rows.join(ids, "id", "left_semi").dropDuplicates(["id"])


def groups(lines: DataFrame, docs: DataFrame, text: str, short: bool = False) -> DataFrame:
    """(id, component) of the lines that have a link to another line. ``lines``: as ``line_rows`` gives them, stored; they are
    discarded."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = partnered(lines.where("n IS NOT NULL"), BAND, PERCENT, SPREAD, partitions)
    discard(lines)
    spent = []

    def known(ids: DataFrame):
        discard(*tiles)  # they are stored again by now
        # pairs come to the lines, time and again: these stay where they are
        texts = bucketed([line_texts(docs, ids, text, short, partitions)], "lines", "id", partitions, placed=True)
        spent.append(texts)
        attributes, line = texts.select("id", "n", "sketch"), texts.select("id", "line")

        def exact(batches):
            for batch in batches:
                good = [similar(x, y) for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)))]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        def verify(pairs: DataFrame) -> DataFrame:
            seen = bounded(pairs, attributes, PERCENT).join(side(line, "a"), "a").join(side(line, "b"), "b")
            return seen.select("a", "b", "line a", "line b").mapInArrow(exact, "a long, b long")

        return verify, attributes

    found = resolve(reduce(DataFrame.unionByName, tiles), known, PERCENT)
    discard(*spent)
    return found


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` with a row number, and (row, numbers) of the lines to drop; the name of the row number."""
    row = free_name(docs.columns, "row")
    counted = numbered(docs, row)
    banded = stored(line_rows(counted, key, text, row, short), "line-bands")
    lines = stored(banded.select("row", "key", "number", "id"), "line-rows")
    linked = groups(banded, docs, text, short)
    members = lines.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    place = F.struct(F.col("key").isNull().alias("z"), "key", "row", "number")
    firsts = members.groupBy("component").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("component", "kept")
    dropped = members.join(firsts, "component").where((F.col("row") != F.col("kept.row")) | (F.col("number") != F.col("kept.number")))
    # written before the texts are joined: the lines and their shuffle files are gone when the texts are shuffled
    drops = stored(dropped.groupBy("row").agg(F.sort_array(F.collect_list("number")).alias("dropped")), "drops", tidy=True)
    discard(lines, linked)
    return counted, drops, row


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False, short: bool = False) -> DataFrame:
    """The columns of ``docs``, repeated lines cut out of the texts; with ``counts`` also n_lines and n_dropped."""
    counted, drops, row = repeated(docs, key, text, short)
    drops = drops.withColumnRenamed("row", row)
    lost = free_name(counted.columns, "dropped")
    both = counted.join(drops.withColumnRenamed("dropped", lost), row, "left")
    # the text is split once: within the outer transform its lines have a name
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    joined = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    kept = F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.get(joined, F.lit(0)))
    columns = [kept.alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        columns += [F.coalesce(feeds + 1, F.lit(0)).alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).alias("n_dropped")]
    return both.select(*columns)
