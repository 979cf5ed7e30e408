"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A text's set: its distinct runs of SHINGLE words (A-Z in lower case, words without white space), or its whole sequence if it
has fewer words. Texts link when 100 * intersection >= PERCENT * union.

Prefixes. In any one order of all shingles, two linked sets share a member among the first n - ceil(0.8 n) + 1 of each. The
order used puts shingles that no other text has first, so a text meets others only if more than four fifths of it is
shared. Which ones are shared is learned from all texts: sorted, delta-coded hashes are sent to the part of the hash space
they belong to, and each part returns its piece of a bit map of fixed size. A wrong bit there costs time, not links.

Tiles. A tile is a prefix shingle and a size band; linked sets lie in one band or two neighbouring ones, and each set goes
to its own and the next. Pairs of one tile are bounded by their parity bit maps (sets that differ in d members differ in
at most d bits), and only pairs that pass are intersected. ``components.resolve`` spares pairs already connected.

Texts with one set are one node, told by 63 bits of its digest, so copies are never paired. Null and blank texts have an
empty set and link with nothing, not even with each other. Rows are told apart by ``frames.numbered``: repeated rows and
ids are members of one component. Texts may be of any length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .components import resolve
from .frames import free_name, numbered, stored
from .sketches import bounded, side, sketch
from .words import SPACE, Words, grams, mix, portions

SHINGLE = 5
PERCENT = 80
FILTER = 27  # bits of the address in the bit map of shared shingles: 16 MB
SHORT = 40  # bits of a hash that are compared to see whether it is shared
PART = 2_000_000  # shingles in one part of the hash space


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, SPACE, lower=True)
    hashes = words.hashes()
    runs, out = grams(hashes, SHINGLE), []
    for low, n in zip(words.bounds.tolist(), words.counts.tolist()):
        out.append(np.unique(runs[low : low + n - SHINGLE + 1]) if n >= SHINGLE else grams(hashes[low : low + n], n) if n else runs[:0])
    return out


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def shared_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """A bit for each value of a hash's first FILTER bits: set if a shingle there occurs in two texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    top = min(FILTER - 3, max(8, math.ceil(math.log2(max(1, size / 6 / PART)))))  # 2 ** top parts

    def packed(batches):
        for batch in batches:
            sets = [s for low, high in portions(batch.column(0)) for s in sets_of(batch.column(0)[low:high])]
            values = np.sort(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - SHORT))
            twice = np.ones(len(values), bool)
            twice[2:] = values[2:] != values[:-2]  # two of each suffice
            values = values[twice]
            part = values >> np.uint64(SHORT - top)
            edges = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(part) else np.zeros(0, int)
            press, rows = zstandard.ZstdCompressor(level=1), []
            for low, high in zip(edges, [*edges[1:], len(values)]):
                own = values[low:high] & np.uint64((1 << (SHORT - top)) - 1)
                steps = np.diff(own, prepend=np.uint64(0)).astype(np.uint32)
                rows.append(press.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes()))  # byte by byte: most are zero
            yield pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int32)), pa.array(rows, pa.binary())], names=["part", "steps"])

    def marked(key, frame):
        import pandas as pd

        # one batch of a part at a time: a part holds about PART values of 8 bytes
        values = [np.zeros(0, np.uint64)]
        for piece in frame["steps"]:
            planes = np.frombuffer(zstandard.decompress(piece), np.uint8).reshape(4, -1)
            values.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)))
        values = np.sort(np.concatenate(values))
        bits = np.zeros(1 << (FILTER - top), bool)
        bits[values[1:][values[1:] == values[:-1]] >> np.uint64(SHORT - FILTER)] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    rows = docs.select(text).mapInArrow(packed, "part int, steps binary").groupBy("part").applyInPandas(marked, "part int, bits binary").collect()
    out = np.zeros(1 << (FILTER - 3), np.uint8)
    step = 1 << (FILTER - top - 3)
    for r in rows:
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def tiled(docs: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """One row for each text: row, key, n, id (null for an empty set); for candidates also tiles, sketch and members."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_shingles(docs, text))
    source = docs.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))

    def rows(batches):
        bits = shared.value
        for batch in batches:
            for low, high in portions(batch.column(2)):
                sizes, ids, tiles, sketches, members = [], [], [], [], []
                for s in sets_of(batch.column(2)[low:high]):
                    n = len(s)
                    sizes.append(n)
                    ids.append(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if n else None)
                    at = s >> np.uint64(64 - FILTER)
                    common = s[(bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0]
                    first = common[: max(0, prefix_size(n) - (n - len(common)))] if n else common
                    if not len(first):
                        tiles.append(None), sketches.append(None), members.append(None)
                        continue
                    band = int(math.log(n) / math.log(100 / PERCENT) + 1e-9)
                    tiles.append(np.concatenate([mix(first + np.uint64(b)) for b in (band, band + 1)]).view(np.int64))
                    sketches.append(sketch(s))
                    members.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[low:high] for i in (0, 1)), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(tiles, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(members, pa.binary())],
                    names=["row", "key", "n", "id", "tiles", "sketch", "members"],
                )

    return source.mapInArrow(rows, f"row long, key {source.schema['key'].dataType.simpleString()}, n long, id long, tiles array<long>, sketch binary, members binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def linked(texts: DataFrame) -> DataFrame:
    """(id, component) of the sets that have a link to another set; ``texts`` as ``tiled`` gives them, stored."""
    candidates = texts.where("tiles IS NOT NULL")
    sketches = candidates.select("id", "n", "sketch").distinct()
    # one row for each set; both joins below read the same exchange
    copy = F.count("*").over(Window.partitionBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    members = candidates.select("id", "members").withColumn("copy", copy).where("copy = 1").select("id", "members")

    def exact(batches):
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        seen = bounded(pairs, sketches, PERCENT).join(side(members, "a"), "a").join(side(members, "b"), "b")
        return seen.select("a", "b", "members a", "members b").mapInArrow(exact, "a long, b long")

    tiles = candidates.select(F.explode("tiles").alias("tile"), "id")
    return resolve(tiles, lambda ids: (verify, sketches), PERCENT)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """``docs`` with a row number, whose name is the last result, and (row, key, n, component, first) of every text:
    the smallest key of the texts it is linked with, directly or not, and that text's row."""
    row = free_name(docs.columns, "row")
    counted = numbered(docs, row)
    texts = stored(tiled(counted, key, text, row), "tiled")
    # an empty set is a component of its own: its number is below zero, as no digest is
    node = F.coalesce(F.col("component"), F.col("id"), -1 - F.col("row"))
    members = texts.select("row", "key", "n", "id").join(linked(texts), "id", "left").withColumn("node", node)
    firsts = members.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("z"), "key", "row")).alias("least"))
    found = members.join(firsts, "node").select("row", "key", "n", F.col("least.key").alias("component"), F.col("least.row").alias("first"))
    return counted, found, row


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first, by key, in their component."""
    counted, found, row = classes(docs, key, text)
    later = found.where("row <> first").select(F.col("row").alias(row))
    return counted.join(later, row, "left_anti").select(*docs.columns)
