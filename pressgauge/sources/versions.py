"""Tables with versions: parts that are replaced as wholes, a log of which folders make up each part, atomic commits.

A table lies in ``data/write=<id>/<part>=<value>/``; parts are days or hash buckets of a key. ``log/<number>.json`` names the
folders of every part for one version, so a read is one scan of the newest version's folders, however many versions there
were. A writer puts its rows into a folder of its own and then creates the log file of the version after the one it read;
creating fails when the file is there, so of two writers one wins and the other gets ``Conflict`` and may try again. Readers
see the old version until then. The log also keeps the last batch of each stream that wrote, in the same commit: a batch
that is replayed after a failure is not written twice.

``merge`` rewrites only the buckets that changes fall into. The stored side is scanned, joined with broadcast changes and
written, never shuffled; changes are taken in groups of buckets whose size is measured and stays below BROADCAST bytes.
``vacuum`` deletes folders that no kept version names, ``compact`` gathers parts that lie in many folders.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pressgauge.session import work_path

BROADCAST = 64 << 20
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Somebody else committed the version that this writer was about to."""


@dataclass
class Snapshot:
    """One version: folders by part, the last batch of each stream and other numbers that writers note."""

    version: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Files:
    """The few calls to Hadoop's file systems that a log needs, made by the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, path: str) -> dict[str, int]:
        """Names in a folder with their times of change in ms; none if there is no folder."""
        p, fs = self.at(path)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)} if fs.exists(p) else {}

    def text(self, path: str) -> str:
        p, fs = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Create a file with all its content or raise Conflict if it is there: write aside, then rename without overwriting."""
        aside, fs = self.at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        target, _ = self.at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        try:
            context.rename(aside, target, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(path) from None
            raise

    def delete(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)


class Versions:
    """A table at ``path`` with the columns of ``schema``; ``by`` gives a row's part, stored as column ``part``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: str, by: Column, kind: T.DataType, order: Iterable[str] = ()):
        self.spark, self.path, self.schema, self.part, self.by, self.kind = spark, path, schema, part, by, kind
        self.order, self.files = list(order), Files(spark)

    @staticmethod
    def buckets(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], n: int = 64, order: Iterable[str] = ()) -> Versions:
        """Parts by a hash of keys."""
        return Versions(spark, path, schema, "bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"), T.IntegerType(), order or keys)

    # --- the log

    def snapshot(self, version: int | None = None) -> Snapshot:
        numbers = [int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[0].isdigit()]
        if version is None:
            version = max(numbers, default=0)
        if not version:
            return Snapshot()
        return Snapshot(**json.loads(self.files.text(self._entry(version))))

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def commit(self, base: Snapshot, parts: dict[str, list[str]], batch: tuple[str, int] | None = None, notes: dict[str, int] | None = None) -> Snapshot:
        batches = {**base.batches, **dict([batch] if batch else []), **(notes or {})}
        new = Snapshot(base.version + 1, {p: f for p, f in parts.items() if f}, batches)
        self.files.create(self._entry(new.version), json.dumps(new.__dict__, sort_keys=True))
        return new

    def has(self, batch: tuple[str, int]) -> bool:
        """Whether a stream's batch is in the table."""
        return self.snapshot().batches.get(batch[0], -1) >= batch[1]

    # --- reading

    def read(self, snapshot: Snapshot | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """The table's columns and its part column, which prunes folders; of the newest version, all parts."""
        snapshot = snapshot or self.snapshot()
        whole = T.StructType([*self.schema.fields, T.StructField(self.part, self.kind)])
        chosen = snapshot.parts if parts is None else {p: snapshot.parts[p] for p in parts if p in snapshot.parts}
        folders = [f"{self.path}/data/write={w}/{self.part}={p}" for p, writes in sorted(chosen.items()) for w in writes]
        if not folders:
            return self.spark.createDataFrame([], whole)
        read = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders)
        return read.select(*whole.names)

    # --- writing

    def settled(self, rows: DataFrame) -> DataFrame:
        """Rows for this table's session. Batches of stateful streams come with adaptive execution off, and without it nothing
        gathers a part's rows: each task would write a file a part. They are written once as they are and read again."""
        if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
            return rows
        path = work_path(self.spark, "rows")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _rows(self, rows: DataFrame) -> DataFrame:
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        return typed.withColumn(self.part, self.by.cast(self.kind))

    def _write(self, rows: DataFrame, write: str, gather: bool) -> None:
        """With ``gather``, files are sized by bytes: a large part is split, small ones share a task."""
        rows = rows.hint("rebalance", self.part) if gather else rows
        rows = rows.sortWithinPartitions(self.part, *self.order)
        rows.write.mode("append").partitionBy(self.part).parquet(f"{self.path}/data/write={write}")

    def _written(self, write: str) -> list[str]:
        names = self.files.names(f"{self.path}/data/write={write}")
        return [n.split("=", 1)[1] for n in names if n.startswith(f"{self.part}=")]

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, tries: int = 5) -> Snapshot | None:
        """Add rows. Appends never contradict other commits, so a lost race is run again. None: the batch is there already."""
        if batch and self.has(batch):
            return None
        write = uuid.uuid4().hex
        self._write(self._rows(self.settled(rows)), write, True)
        for left in reversed(range(tries)):
            base = self.snapshot()
            parts = {p: list(f) for p, f in base.parts.items()}
            for p in self._written(write):
                parts.setdefault(p, []).append(write)
            try:
                return self.commit(base, parts, batch)
            except Conflict:
                if not left:
                    raise

    def replace(self, rows: DataFrame, parts: Iterable[str], base: Snapshot | None = None, batch: tuple[str, int] | None = None) -> Snapshot:
        """A version in which ``parts`` hold exactly ``rows``, which have no others; a part without rows leaves the table."""
        base = base or self.snapshot()
        write = uuid.uuid4().hex
        self._write(self._rows(rows), write, True)
        kept = {p: f for p, f in base.parts.items() if p not in set(parts)}
        for p in self._written(write):
            kept[p] = [*kept.get(p, []), write]
        return self.commit(base, kept, batch)

    def merge(self, changes: DataFrame, keys: list[str], how: str = "upsert", columns: list[str] | None = None, batch: tuple[str, int] | None = None, notes: dict[str, int] | None = None, broadcast: int = BROADCAST) -> Snapshot | None:
        """Apply changes by key: ``upsert`` replaces or adds rows, ``update`` sets ``columns`` of stored rows,
        ``delete`` removes them. Changes have one row a key and at least the columns that parts are made from."""
        if batch and self.has(batch):
            return None
        base, write = self.snapshot(), uuid.uuid4().hex
        needed = {"upsert": self.schema.names, "update": [*keys, *(columns or [])], "delete": keys}[how]
        touched = set()
        sized = [*keys, *(columns or [])] if how == "update" else keys
        for group, mine, small in self._by_bucket(changes, needed, sized, broadcast):
            touched.update(group)
            side = F.broadcast if small else (lambda df: df)
            stored = self.read(base, group)
            if how == "update":
                found = mine.select(*keys, F.struct(*columns).alias("new values"))
                joined = stored.join(side(found), keys, "left")
                values = {c: F.when(F.col("new values").isNotNull(), F.col("new values")[c]).otherwise(F.col(c)) for c in columns}
                self._write(joined.withColumns(values).select(*stored.columns), write, False)
                continue
            kept = stored.join(side(mine.select(*keys)), keys, "left_anti").select(*stored.columns)
            self._write(kept, write, False)
            if how == "upsert":
                self._write(self._rows(mine), write, True)
        parts = {p: f for p, f in base.parts.items() if p not in touched}
        parts.update({p: [write] for p in self._written(write)})
        return self.commit(base, parts, batch, notes)

    def _gathered(self, rows: DataFrame, columns: list[str], sized: list[str]) -> tuple[DataFrame, dict[str, int]]:
        """Rows written once into a folder a bucket, and the bytes that ``sized`` columns take in each. What is read of a
        bucket's rows costs that bucket only, however many others there are."""
        types = {f.name: f.dataType for f in self.schema.fields}
        named = self.settled(rows).select(*[F.col(c).cast(types[c]) for c in columns]).withColumn(self.part, self.by.cast(self.kind))
        path = work_path(self.spark, "pending")
        named.hint("rebalance", self.part).write.partitionBy(self.part).parquet(path)
        pending = self.spark.read.schema(named.schema).parquet(path).select(*named.columns)
        size = F.lit(64) + F.octet_length(F.to_json(F.struct(*sized)))
        counted = pending.groupBy(self.part).agg(F.sum(size).alias("bytes")).collect()  # a row a bucket
        return pending, {NULL_PART if r[0] is None else str(r[0]): r["bytes"] for r in counted}

    def _of(self, pending: DataFrame, group: list[str]) -> DataFrame:
        """Rows of the buckets in ``group``; only their folders are read."""
        values = [F.lit(p).cast(self.kind) for p in group if p != NULL_PART]
        chosen = F.col(self.part).isin(*values) if values else F.lit(False)
        return pending.where(chosen | F.col(self.part).isNull() if NULL_PART in group else chosen).drop(self.part)

    def _by_bucket(self, rows: DataFrame, columns: list[str], sized: list[str], broadcast: int) -> Iterable[tuple[list[str], DataFrame, bool]]:
        """Rows (written once) in groups of buckets, each with its buckets and whether the measured size of its ``sized``
        columns may be broadcast."""
        pending, sizes = self._gathered(rows, columns, sized)
        for group, small in _groups(sizes, broadcast):
            yield group, self._of(pending, group), small

    def missing(self, rows: DataFrame, keys: list[str], broadcast: int = BROADCAST) -> DataFrame:
        """The rows whose keys the table lacks. Only key columns of the buckets that rows fall into are read, and they are
        not shuffled where the keys that ask can be broadcast to them, group by group; larger buckets are joined at once.
        Rows of buckets that the table does not have need no look."""
        base = self.snapshot()
        if not base.parts:
            return rows.select(*self.schema.names)
        pending, sizes = self._gathered(rows, self.schema.names, keys)
        there = {p: size for p, size in sizes.items() if p in base.parts}
        groups = list(_groups(there, broadcast))
        large = [p for group, small in groups if not small for p in group]
        groups = [group for group, small in groups if small]
        fresh, path = self._of(pending, [p for p in sizes if p not in there]), work_path(self.spark, "known")
        for group in [*groups, *([large] if large else [])]:
            asked = self._of(pending, group).select(*keys).distinct()
            found = self.read(base, group).select(*keys).join(asked if group is large else F.broadcast(asked), keys, "left_semi")
            found.distinct().write.mode("append").parquet(path)
        if there:
            known = self.spark.read.schema(pending.select(*keys).schema).parquet(path)
            fresh = fresh.unionByName(self._of(pending, list(there)).join(known, keys, "left_anti"))
        return fresh.select(*self.schema.names)

    # --- upkeep

    def compact(self, most: int = 4) -> int:
        """Rewrite parts that lie in more than ``most`` folders. Returns how many."""
        base = self.snapshot()
        many = [p for p, writes in base.parts.items() if len(writes) > most]
        if many:
            self.replace(self.read(base, many), many, base)
        return len(many)

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Delete folders that the newest ``keep`` versions do not name, and older log entries. Returns how many folders.

        Folders younger than ``hours`` stay: a writer may be about to commit them.
        """
        newest = self.snapshot().version
        logged = sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[0].isdigit())
        kept = [v for v in logged if v > newest - keep]
        named = {(w, p) for v in kept for p, writes in self.snapshot(v).parts.items() for w in writes}
        before, gone = (time.time() - hours * 3600) * 1000, 0
        for v in logged:
            if v not in kept:
                self.files.delete(self._entry(v))
        for folder, changed in self.files.names(f"{self.path}/data").items():
            write = folder.removeprefix("write=")
            if changed > before:
                continue
            parts = self._written(write)
            dead = [p for p in parts if (write, p) not in named]
            for p in dead:
                self.files.delete(f"{self.path}/data/{folder}/{self.part}={p}")
            if len(dead) == len(parts):
                self.files.delete(f"{self.path}/data/{folder}")
            gone += len(dead)
        return gone


def _groups(sizes: dict[str, int], limit: int) -> Iterable[tuple[list[str], bool]]:
    """Buckets in groups of at most ``limit`` bytes, and whether a group is that small: one bucket alone may not be."""
    group, total = [], 0
    for p in sorted(sizes):
        if group and total + sizes[p] > limit:
            yield group, True
            group, total = [], 0
        if sizes[p] > limit:
            yield [p], False
            continue
        group.append(p)
        total += sizes[p]
    if group:
        yield group, True
