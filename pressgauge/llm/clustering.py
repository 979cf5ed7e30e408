"""Centroid clustering (Lloyd's algorithm, exactly) with heap-ordered bounds.

Vectors are integers floor(scale * x), all arithmetic on them is exact. For each vector the gap between the distances to
its second-nearest and its nearest centroid is known when it is scanned. When centroids move, the gap of any vector of
cluster c shrinks by no more than c's move plus the largest move of another centroid; ``drift[c]`` adds these up. A vector's
key is its gap plus the drift at its scan. Each cluster keeps its vectors in a binary heap by key, one heap a block, so that
a cluster with most of the vectors is spread like any other. In each round the vectors whose key the drift has reached are
popped, scanned against all centroids, and pushed on the heap of their nearest; the others keep their cluster unseen, and
heaps whose top holds are not even unpacked. SLACK a round makes up for rounding of keys; vectors at a tie have no gap, so
they are popped and the smaller number wins.

Sums of clusters change by the vectors that moved. The driver has the centroids and sums only.

Null vectors, those of another length, and those with null or non-finite components are dropped. A null id counts in all but
the choice of the first centroids, where it comes last. Equal ids are ordered by their vectors. Components beyond
``blocks.limit_of`` (1.3e8 for 64 components) count as that. Fewer vectors than centroids: as many centroids as vectors.
Repeated rows are vectors of their own. An empty table gives no rows. Of other columns only those of ``keep`` are read;
they may have any name, also names of results, which follow them.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import Blocks, arithmetic, as_long, doubles, finite, scaled

SLACK = 1e-5
STATE = [T.StructField("cluster", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("members", T.BinaryType())]
RESULT = [T.StructField("cluster", T.ArrayType(T.IntegerType())), T.StructField("distance", T.ArrayType(T.LongType()))]


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centers."""
    kind = arithmetic(x.shape[1], x, centers)
    if kind is np.float64:  # integers below 2**53 throughout
        a, b = x.astype(kind), centers.astype(kind)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.column_stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centers])


class Heaps:
    """The heaps of one block's clusters, unpacked when they are touched."""

    def __init__(self, k: int, cluster: np.ndarray, keys: np.ndarray, members: np.ndarray):
        edges = np.concatenate([[0], np.cumsum(np.bincount(cluster, minlength=k))]) if len(keys) else np.zeros(k + 1, int)
        self.keys = [keys[a:b] for a, b in zip(edges, edges[1:])]
        self.members = [members[a:b] for a, b in zip(edges, edges[1:])]
        self.open: dict[int, list] = {}

    def opened(self, c: int) -> list:
        if c not in self.open:
            self.open[c] = list(zip(self.keys[c].tolist(), self.members[c].tolist()))
        return self.open[c]

    def pop_expired(self, drift: np.ndarray) -> list[int]:
        out = []
        for c, keys in enumerate(self.keys):
            if len(keys) and keys[0] <= drift[c]:
                heap = self.opened(c)
                while heap and heap[0][0] <= drift[c]:
                    out.append(heapq.heappop(heap)[1])
        return out

    def push(self, c: int, key: float, member: int) -> None:
        heapq.heappush(self.opened(c), (key, member))

    def packed(self) -> tuple[bytes, bytes]:
        for c, heap in self.open.items():
            self.keys[c] = np.array([key for key, _ in heap], np.float64)
            self.members[c] = np.array([m for _, m in heap], np.int32)
        return np.concatenate(self.keys).tobytes(), np.concatenate(self.members).astype(np.int32).tobytes()


def assigned(x: np.ndarray, state: dict, centers: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, Heaps, np.ndarray]:
    """Clusters of a block's vectors, its heaps, and the change of (sums, counts) by cluster."""
    k, dims = centers.shape
    change = np.zeros((k, dims + 1), np.int64)
    fresh = "cluster" not in state
    cluster = np.zeros(len(x), np.int32) if fresh else np.frombuffer(state["cluster"], np.int32).copy()
    keys, members = (np.zeros(0), np.zeros(0, np.int32)) if fresh else (np.frombuffer(state["keys"], np.float64), np.frombuffer(state["members"], np.int32))
    heaps = Heaps(k, cluster, keys, members)
    scan = np.arange(len(x)) if fresh else np.array(heaps.pop_expired(drift), np.int64)
    if len(scan):
        far = squared(x[scan], centers)
        nearest = far.argmin(1)  # the smaller number at ties
        own = far[np.arange(len(scan)), nearest]
        far[np.arange(len(scan)), nearest] = np.iinfo(np.int64).max
        gap = np.sqrt(far.min(1).astype(np.float64)) - np.sqrt(own.astype(np.float64)) if k > 1 else np.full(len(scan), np.inf)
        for c, key, i in zip(nearest.tolist(), (gap + drift[nearest]).tolist(), scan.tolist()):
            heaps.push(c, key, i)
        moved = np.ones(len(scan), bool) if fresh else cluster[scan] != nearest
        rows = np.column_stack([x[scan[moved]], np.ones(moved.sum(), np.int64)]).astype(np.int64)
        np.add.at(change, nearest[moved], rows)
        if not fresh:
            np.subtract.at(change, cluster[scan[moved]], rows)
        cluster[scan] = nearest
    return cluster, heaps, change


def cluster(
    rows: DataFrame, vector: str, id: str, keep: list[str], k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """Cluster and squared distance of every vector, after ``keep``; the centroids; the summed distances by cluster.

    The first centroids are the k vectors with the smallest sha256 of ``seed:id``.
    """
    v = doubles(vector)
    kept = rows.where((F.size(v) == dims) & finite(v))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)
    first = kept.select(named.alias("named"), v.alias("vector")).orderBy(F.col("named").asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        none = T.StructType([*rows.select(*keep).schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return rows.sparkSession.createDataFrame([], none), [], []
    centers = scaled(np.array([r["vector"] for r in first]), scale, dims)
    k, drift, sums = len(centers), np.zeros(len(centers)), np.zeros((len(centers), dims + 1), object)
    blocks = Blocks(kept, vector, keep, dims, scale)

    for _ in range(rounds):
        def scan(x, state, centers=centers, drift=drift):
            found, heaps, change = assigned(x, state, centers, drift)
            keys, members = heaps.packed()
            return {"cluster": found.tobytes(), "keys": keys, "members": members}, change.ravel()

        sums += blocks.advance(scan, STATE, k * (dims + 1), "clusters").reshape(k, dims + 1)
        placed = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, centers)], np.int64)
        moves = np.sqrt(((placed - centers).astype(np.float64) ** 2).sum(1))
        others = np.array([max([m for j, m in enumerate(moves) if j != c], default=0.0) for c in range(k)])
        centers, drift = placed, drift + moves + others + SLACK

    def measure(x, state):
        found, _, _ = assigned(x, state, centers, drift)
        kind = arithmetic(dims, x, centers)
        distance = ((x.astype(kind) - centers[found].astype(kind)) ** 2).sum(1).astype(np.int64)
        # in halves of 32 bits, so that sums of a task's distances stay within a long
        total = np.zeros((k, 2), np.int64)
        np.add.at(total, found, np.column_stack([distance >> 32, distance & 0xFFFFFFFF]))
        return {"cluster": found.tolist(), "distance": distance.tolist()}, total.ravel()

    halves = blocks.advance(measure, RESULT, 2 * k, "distances").reshape(k, 2)
    return blocks.rows("cluster", "distance"), centers.tolist(), [int(high << 32) + int(low) for high, low in halves]


def labelled(rows: DataFrame, centers: list[list[int]], inertias: list[int]) -> DataFrame:
    """Adds what holds for a vector's whole cluster: summed distances and the digest of its centroid."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    at = F.col("cluster") + 1
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at) if values else F.lit(None).cast(kind)
    return rows.withColumns({
        "cluster_inertia": of([as_long(i) for i in inertias], "long"), "inertia": F.lit(as_long(sum(inertias))).cast("long"),
        "centroid_sha256": of(digests, "string"),
    })
