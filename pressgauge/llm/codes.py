"""Vector codes by product quantisation; the codebooks are learned by ball k-means, exactly.

Vectors are integers floor(scale * x), cut into equal parts; each part position has a codebook of entries. An entry and its
parts are a ball; balls are kept block by block, so that an entry with most of the parts is spread like any other. A ball's
radius, the largest distance of a part to its entry, defines the entry's neighbours: those no farther than twice the radius.
No other entry can win a part of the ball. Balls whose entry and neighbours stayed where they were are stable: their parts
are not looked at. In the others a part at distance d has as candidates only the neighbours within 2 d of its entry: none
for the core, one more for each ring around it. Candidates are compared by exact squared distances, the lower index at
ties. SLACK widens balls and rings against rounding of square roots, which only adds candidates.

Sums of entries change by the parts that moved. The driver has the codebooks and sums only.

Rows whose vector is null or has null or non-finite components are dropped. Vectors cannot be coded if their length is
not that of the smallest kept id whose length is a positive multiple of the number of parts: such rows stay, with null
codes and errors. Null ids come last, equal ids are ordered by their vectors. Components beyond ``blocks.limit_of`` count as
that. Fewer vectors than entries: as many entries as vectors. Repeated rows are vectors of their own. An empty table gives
no rows. Of other columns only those of ``keep`` are read; they may have any name, also names of results, which follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import Blocks, arithmetic, doubles, finite, scaled

SLACK = 1e-5
SALTS = 32
STATE = [T.StructField("codes", T.BinaryType()), T.StructField("radii", T.BinaryType())]
RESULT = [T.StructField("code", T.ArrayType(T.StringType())), T.StructField("error", T.ArrayType(T.LongType()))]


class Books:
    """Codebooks (part, entry, component), which entries have just moved, and for each entry the others by distance."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries, moved
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]).astype(np.float64) ** 2).sum(3)
        self.half = np.sqrt(apart) / 2
        np.einsum("pii->pi", self.half)[:] = -1  # itself comes first
        self.order = self.half.argsort(2, kind="stable")[:, :, 1:]
        self.rings = np.take_along_axis(self.half, self.order, 2)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    kind = arithmetic(x.shape[1], x, entries)
    return ((x.astype(kind) - entries.astype(kind)) ** 2).sum(1).astype(np.int64)


def _nearest_of_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, code = distances(x, np.broadcast_to(entries[0], x.shape)), np.zeros(len(x), np.int64)
    for e in range(1, len(entries)):
        d = distances(x, np.broadcast_to(entries[e], x.shape))
        code[d < best] = e
        best = np.minimum(best, d)
    return code, best


def assign(x: np.ndarray, state: dict, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (vector, part) of a block, radii of its balls (part, entry), and the change of (sums, counts)."""
    parts, k, width = books.entries.shape
    change = np.zeros((parts, k, width + 1), np.int64)
    n = len(x)
    flat = x.reshape(n * parts, width).astype(np.int64)
    part = np.tile(np.arange(parts), n)
    if "codes" not in state:
        code, best = np.zeros(n * parts, np.int64), np.zeros(n * parts, np.int64)
        for p in range(parts):
            code[p::parts], best[p::parts] = _nearest_of_all(flat[p::parts], books.entries[p])
        radii = np.zeros((parts, k))
        np.maximum.at(radii, (part, code), np.sqrt(best))
        np.add.at(change, (part, code), np.column_stack([flat, np.ones(len(flat), np.int64)]))
        return code, radii, change

    before = np.frombuffer(state["codes"], np.uint8).astype(np.int64)
    radii = np.frombuffer(state["radii"], np.float64).reshape(parts, k).copy()
    near = books.half <= radii[:, :, None] + SLACK  # neighbours of a ball that has not moved, and itself
    stable = ~(near & books.moved[:, None, :]).any(2)
    look = np.flatnonzero(~stable[part, before])
    radii[~stable] = 0
    code = before.copy()
    if len(look):
        p, own, part_x = part[look], before[look], flat[look]
        best = distances(part_x, books.entries[p, own])
        # each ball's radius around the moved entry, then how many neighbours each part's ring has
        ball = np.zeros((parts, k))
        np.maximum.at(ball, (p, own), np.sqrt(best))
        neighbours = (books.rings <= ball[:, :, None] + SLACK).sum(2)
        rings = (books.rings[p, own, : neighbours.max(initial=0)] <= (np.sqrt(best) + SLACK)[:, None]).sum(1)
        chosen = own.copy()
        for ring in range(rings.max(initial=0)):
            at = np.flatnonzero(rings > ring)
            other = books.order[p[at], own[at], ring]
            d = distances(part_x[at], books.entries[p[at], other])
            wins = (d < best[at]) | ((d == best[at]) & (other < chosen[at]))
            best[at[wins]], chosen[at[wins]] = d[wins], other[wins]
        code[look] = chosen
        np.maximum.at(radii, (p, chosen), np.sqrt(best))
        moved = np.flatnonzero(chosen != own)
        rows = np.column_stack([part_x[moved], np.ones(len(moved), np.int64)])
        np.add.at(change, (p[moved], chosen[moved]), rows)
        np.subtract.at(change, (p[moved], own[moved]), rows)
    return code, radii, change


def encode(
    rows: DataFrame, vector: str, id: str, keep: list[str], parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """Code and squared error of every vector, after ``keep``; the codebooks (part, entry, component).

    ``entries`` is at most 256: a code has two hex digits a part. Codebooks start as the vectors with the smallest ids.
    """
    v = doubles(vector)
    whole = rows.where(finite(v))
    of_id = [F.col(id).asc_nulls_last(), v.asc()]
    first = whole.where((F.size(v) > 0) & (F.size(v) % parts == 0)).orderBy(*of_id).limit(entries).select(v.alias("vector")).collect()
    kept = [F.col(c) for c in keep]
    uncoded = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if not first:
        return whole.select(*kept, *uncoded), np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0]["vector"])
    alike = whole.where(F.size(v) == dims)
    if any(len(r["vector"]) != dims for r in first):
        first = alike.orderBy(*of_id).limit(entries).select(v.alias("vector")).collect()
    width, k = dims // parts, len(first)
    values = scaled(np.array([r["vector"] for r in first]), scale, dims)
    books = Books(values.reshape(k, parts, width).transpose(1, 0, 2), np.ones((parts, k), bool))
    sums = np.zeros((parts, k, width + 1), object)
    blocks = Blocks(alike, vector, keep, dims, scale)

    for _ in range(rounds):
        def scan(x, state, books=books):
            code, radii, change = assign(x, state, books)
            return {"codes": code.astype(np.uint8).tobytes(), "radii": radii.tobytes()}, change.ravel()

        sums += blocks.advance(scan, STATE, sums.size, "codes").reshape(sums.shape)
        placed = books.entries.copy()
        for p, e in zip(*np.nonzero(sums[:, :, -1])):
            placed[p, e] = [s // sums[p, e, -1] for s in sums[p, e, :-1]]
        books = Books(placed, (placed != books.entries).any(2))

    def measure(x, state):
        code, _, _ = assign(x, state, books)
        codes = code.reshape(len(x), parts)
        chosen = books.entries[np.arange(parts), codes].reshape(x.shape)
        return {"code": [c.tobytes().hex() for c in codes.astype(np.uint8)], "error": distances(x, chosen).tolist()}, np.zeros(1, np.int64)

    blocks.advance(measure, RESULT, 1, "errors")
    coded = blocks.rows("code", "error")
    return coded.unionAll(whole.where(F.size(v) != dims).select(*kept, *uncoded)), books.entries


def with_label_errors(coded: DataFrame, label: str, id: str) -> DataFrame:
    """Adds the summed error of each row's label; null is a label. Rows of one label are spread over SALTS tasks."""
    totals = coded.groupBy(F.col(label).alias("of")).agg(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)).alias("total"))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64(id, "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, salted[label].eqNullSafe(totals["of"]) & (salted["salt"] == totals["salt"]), "left")
    return joined.select(*[salted[c] for c in coded.columns], F.col("total").try_cast("long").alias("label_error"))


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
