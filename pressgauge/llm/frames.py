"""Small helpers for frames: free column names, shared folder, tables written between steps."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import work_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column has that name (names compare without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


@contextmanager
def tidied(spark: SparkSession):
    """Shuffle files of what runs within go when it ends, not when the driver collects its garbage."""
    conf = spark.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and sizes are known afterwards.

    With ``tidy``, the shuffle files of the write go when it ends.
    """
    path = work_path(df.sparkSession, name)
    with tidied(df.sparkSession) if tidy else nullcontext():
        df.write.parquet(path, compression="zstd")
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def bucketed(parts: list[DataFrame], name: str, key: str, buckets: int, placed: bool = False) -> DataFrame:
    """Frames of the same columns, ``stored`` together in buckets of ``key``. They are shuffled once, here and one after the
    other; whatever groups or joins the table by ``key`` shuffles the other side only. ``placed``: they are in as many partitions
    of ``key`` already."""
    df, spark = parts[0], parts[0].sparkSession
    path = work_path(spark, name)
    known_as = path.rsplit("/", 1)[-1].replace("-", "_")
    _folder(spark, path, "mkdirs")  # Spark warns of tables without one
    spark.sql(f"CREATE TABLE `{known_as}` ({df.schema.toDDL()}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    with tidied(spark):
        for part in parts:
            (part if placed else part.repartition(buckets, key)).write.insertInto(known_as)
    read = spark.table(known_as)
    read.stored_at, read.known_as = path, known_as
    return read


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` or ``bucketed`` wrote and that nothing still to be computed reads."""
    for frame in frames:
        spark = frame.sparkSession
        if hasattr(frame, "known_as"):
            spark.sql(f"DROP TABLE `{frame.known_as}`")
        _folder(spark, frame.stored_at, "delete", True)


def _folder(spark: SparkSession, path: str, call: str, *more) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(path.getFileSystem(spark._jsc.hadoopConfiguration()), call)(path, *more)


FILES = 500_000


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number for each row, as the column ``row``: the same one whenever and however the frame is read.

    A row of a Parquet table is known by its file and its place there, whatever partitions a scan makes of the files; its
    number is made of the file's (from a table written once, broadcast up to FILES files) and that place. Rows of anything
    else are written once with their numbers.
    """
    if _is_scan(docs):
        metadata = docs.metadataColumn("_metadata")
        path = free_name(docs.columns, "file")
        files = docs.select(metadata["file_path"].alias(path)).distinct()
        files = stored(files.withColumn("file no", F.row_number().over(Window.orderBy(path)).cast("long")), "files")
        if files.count() <= FILES:
            place = free_name(docs.columns, "place")
            placed = docs.select("*", metadata["file_path"].alias(path), metadata["row_index"].alias(place)).join(F.broadcast(files), path)
            return placed.select(*docs.columns, F.shiftleft("file no", 40).bitwiseOR(F.col(place)).alias(row))
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file: a scan, then only projections and filters."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.simpleString(25).rsplit("]", 1)[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
