"""Integer vectors packed into block rows, for jobs that pass over them many times.

A block row has up to BLOCK_BYTES of vectors as one binary column, what is kept of their rows as an array of structs, and
the state that an algorithm carries from one pass to the next. A pass (``advance``) maps each block to its next state,
writes the blocks to the shared folder and adds up what the pass changed in fixed-size sums. No pass shuffles vectors, and
a block depends on nothing but itself and the driver's few centroids, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .frames import discard, stored

BLOCK_BYTES = 48 << 10


def doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def finite(vector: Column) -> Column:
    """Neither null nor with components that are null, infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def limit_of(dims: int) -> int:
    """Largest magnitude whose squared distances fit a long; larger components count as this."""
    return int((2**62 / max(dims, 1)) ** 0.5 / 2)


def scaled(values: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * value), held within ``limit_of``."""
    limit = limit_of(dims)
    return np.clip(np.floor(values * scale), -limit, limit).astype(np.int64)


def arithmetic(dims: int, *arrays: np.ndarray) -> type:
    """float64 where squared distances of these integers are exact in it, else int64."""
    largest = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return np.float64 if 4 * dims * largest * largest < 1 << 53 else np.int64


class Blocks:
    """Vectors of ``dims`` components, as integers floor(scale * x), with the columns ``keep`` of their rows."""

    def __init__(self, rows: DataFrame, vector: str, keep: list[str], dims: int, scale: int):
        self.keep, self.dims, self.scale = keep, dims, scale
        kept = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept")
        narrow = rows.select(kept, doubles(vector).alias("vector"))
        self.kept_type = T.ArrayType(narrow.schema["kept"].dataType)
        self.state = stored(narrow.mapInArrow(self._pack(), self.schema()), "blocks")

    def schema(self, *more: T.StructField) -> T.StructType:
        return T.StructType([T.StructField("kept", self.kept_type), T.StructField("data", T.BinaryType()), *more])

    def _pack(self):
        dims, scale = self.dims, self.scale

        def pack(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale, dims)
                kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(values).max() <= np.iinfo(k).max)
                step = max(1, BLOCK_BYTES // (dims * np.dtype(kind).itemsize))
                edges = [*range(0, len(values), step), len(values)]
                data = [values[a:b].astype(kind).tobytes() for a, b in zip(edges, edges[1:])]
                kept = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([kept, pa.array(data, pa.binary())], names=["kept", "data"])

        return pack

    def advance(self, step: Callable, fields: list[T.StructField], size: int, name: str) -> np.ndarray:
        """Replace each block's state by ``step(vectors, state)``, which returns the new state as a dict of ``fields``, and
        changes to add up, ``size`` integers. Returns their sums over all blocks."""
        dims, names = self.dims, [f.name for f in fields]
        out = self.schema(*fields, T.StructField("change", T.ArrayType(T.LongType())))
        kinds = {f.name: _arrow(f.dataType) for f in fields}

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if not batch.num_rows:
                    continue
                old = [n for n in batch.schema.names if n not in ("kept", "data", "change")]
                new, total = {n: [] for n in names}, np.zeros(size, np.int64)
                for i in range(batch.num_rows):
                    n = len(batch.column("kept")[i])
                    data = batch.column("data")[i].as_buffer()
                    x = np.frombuffer(data, f"i{len(data) // (n * dims)}").reshape(n, dims)
                    made, change = step(x, {c: batch.column(c)[i].as_py() for c in old})
                    total += change
                    for c in names:
                        new[c].append(made[c])
                # the changes of the batch lie in its first row
                changes = pa.array([total.tolist()] + [None] * (batch.num_rows - 1), pa.list_(pa.int64()))
                columns = [batch.column("kept"), batch.column("data"), *[pa.array(new[c], kinds[c]) for c in names], changes]
                yield pa.RecordBatch.from_arrays(columns, names=["kept", "data", *names, "change"])

        before = self.state
        self.state = stored(before.mapInArrow(run, out), name)
        discard(before)
        sums = self.state.where("change IS NOT NULL").select(F.posexplode("change")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")))
        found = np.zeros(size, object)
        for pos, value in sums.collect():  # ``size`` rows
            found[pos] = int(value)
        return found

    def rows(self, *columns: str) -> DataFrame:
        """A row for each vector again: what was kept, and its item of each of the array columns."""
        zipped = self.state.select(F.explode(F.arrays_zip("kept", *columns)).alias("x"))
        kept = [F.col(f"x.kept.k{i}").alias(c) for i, c in enumerate(self.keep)]
        return zipped.select(*kept, *[F.col(f"x.{c}").alias(c) for c in columns])


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(kind)]


def as_long(value: int) -> int | None:
    """None where a long cannot hold it."""
    return value if value < 1 << 63 else None
