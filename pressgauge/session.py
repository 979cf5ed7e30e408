"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts go to Python: fewer of them at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
# Only for sessions built here. HotSpot never compiles methods above 8000 bytes; beyond it, plain operators are faster.
OWN_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "pressgauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **OWN_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created, and send it the code."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session (tests) may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="pressgauge-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and keep as Parquet in the shared folder, for rows that several branches read.

    Outlives lost executors, unlike a cache; and Spark knows the real size of what it reads back.
    """
    path = work_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` with counts of the rows written, observed by the job that writes them: no second pass."""
    seen = Observation()
    rows = materialize(df.observe(seen, *[count.alias(name) for name, count in counts.items()]))
    return rows, {name: int(seen.get.get(name) or 0) for name in counts}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_pressgauge_shipped", False):
        return
    package = pathlib.Path(__file__).parent
    # The driver starts Python workers of its own for stateful streams; they do not get the file below.
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    context.environment["PYTHONPATH"] = os.pathsep.join([*paths, str(package.parent)])
    archive = pathlib.Path(tempfile.mkdtemp(prefix="pressgauge-")) / "pressgauge.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, pathlib.Path(package.name) / file.relative_to(package))
    context.addPyFile(str(archive))  # Spark serves the driver's file to every executor
    context._pressgauge_shipped = True
