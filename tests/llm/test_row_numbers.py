"""Rows keep their numbers when a scan is planned again with other partitions, as after a change of executors."""

import pytest
from odd import documents
from pyspark.sql import functions as F

from pressgauge.llm import jaccard, lines, quality
from pressgauge.llm.frames import numbered, table

SETTING = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The small documents in twelve files of different sizes."""
    path = str(tmp_path_factory.mktemp("files") / "documents.parquet")
    table(spark, "/root/testdata/sf0.001", "documents").repartition(12, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7))).write.parquet(path)
    return path


@pytest.fixture
def planned(spark, docs):
    """Call an operator while twelve cores are planned for, act on its result with three."""

    def run(operator, act=lambda df: sorted(map(str, df.collect()))):
        results = []
        for later in ("12", "3"):
            spark.conf.set(SETTING, "12")
            made = operator(spark.read.parquet(docs))
            spark.conf.set(SETTING, later)
            results.append(act(made))
        return results

    before = spark.conf.get(SETTING, None)
    yield run
    spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def test_numbers(spark, docs, planned):
    plain, again = planned(lambda d: numbered(d.select("doc_id", "text"), "row").select("doc_id", "row"))
    assert plain == again and len({r.split("row=")[1] for r in plain}) == len(plain)
    frame = spark.read.parquet(docs)
    # projections and filters keep rows; anything else is written with its numbers
    assert numbered(frame.where("doc_id % 2 = 0").select("doc_id"), "row").distinct().count() == frame.where("doc_id % 2 = 0").count()
    twice = numbered(frame.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")), "row")
    assert twice.select("row").distinct().count() == 2 * frame.count()
    odd = numbered(documents(spark).withColumn("_metadata", F.lit(1)).withColumn("file", F.lit(1)).withColumn("place", F.lit(1)), "number")
    assert odd.select("number").distinct().count() == documents(spark).count()


def test_lines(planned):
    plain, again = planned(lambda d: lines.dedup(d, counts=True, short=True))
    assert plain == again


def test_near_duplicates(planned):
    plain, again = planned(jaccard.distinct_documents)
    assert plain == again


def test_quality(spark, planned):
    trusted = table(spark, "/root/testdata/sf0.001", "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    plain, again = planned(lambda d: quality.accepted(d, trusted, quantile=0.5, least=1))
    assert plain == again and len(plain) < 200
