"""Versioned tables: merges by bucket, conflicts, replayed batches, compaction, and deletion from disk."""

import pathlib

import pytest
from pyspark.sql import functions as F, types as T

from pressgauge.sources.versions import Conflict, Versions, _groups

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("owner", T.LongType()), T.StructField("text", T.StringType())])


def table(spark, path, n=8):
    return Versions.buckets(spark, str(path), SCHEMA, ["id"], n)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(store, *args):
    return sorted(tuple(r) for r in store.read(*args).select(*SCHEMA.names).collect())


def files(path):
    return {str(p) for p in pathlib.Path(path).rglob("*.parquet")}


def test_merge_touches_only_its_buckets(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    assert rows(store) == [] and store.read().columns == ["id", "owner", "text", "bucket"]
    first = [(i, i % 3, f"t{i}") for i in range(100)]
    store.append(frame(spark, first))
    assert rows(store) == first
    before = files(tmp_path)
    bucket = {r.id: r.bucket for r in store.read().collect()}
    store.merge(frame(spark, [(5, 9, "new"), (1000, 1, "added")]), ["id"])
    want = sorted([(5, 9, "new"), (1000, 1, "added"), *[r for r in first if r[0] != 5]])
    assert rows(store) == want
    touched = {bucket[5], next(r.bucket for r in store.read().where("id = 1000").collect())}
    new = files(tmp_path) - before
    assert before <= files(tmp_path) and {int(p.split("bucket=")[1].split("/")[0]) for p in new} == touched
    still = store.snapshot().parts
    assert all(len(w) == 1 for w in still.values()) and sum(1 for b, w in still.items() if w != [*store.snapshot(1).parts[b]]) == len(touched)
    # the old version is still there, and goes with its texts when the table is vacuumed
    assert rows(store, store.snapshot(1)) == first
    assert store.vacuum(hours=1) == 0
    assert store.vacuum(hours=0) == len(touched) and rows(store) == want
    assert not any("t5" in set(spark.read.parquet(f).toPandas()["text"]) for f in files(tmp_path))


def test_update_and_delete(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    store.append(frame(spark, [(i, i % 2, f"t{i}") for i in range(10)]))
    store.merge(spark.createDataFrame([(3, "three"), (77, "nobody")], "id int, text string"), ["id"], "update", ["text"])
    assert dict((r[0], r[2]) for r in rows(store))[3] == "three" and len(rows(store)) == 10
    store.merge(spark.createDataFrame([(3, None)], "id long, text string"), ["id"], "update", ["text"])
    assert dict((r[0], r[2]) for r in rows(store))[3] is None
    # somebody else's row stays
    store.merge(spark.createDataFrame([(4, 0), (5, 0), (4, 0)], "id long, owner long"), ["id", "owner"], "delete")
    assert [r[0] for r in rows(store)] == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    store.merge(store.read().select("id"), ["id"], "delete")
    assert rows(store) == [] and store.snapshot().parts == {}
    store.append(frame(spark, [(1, 1, "again")]))
    assert rows(store) == [(1, 1, "again")]


def test_stored_side_is_not_shuffled(spark, tmp_path, monkeypatch):
    store = table(spark, tmp_path / "t")
    store.append(frame(spark, [(i, 0, "x") for i in range(50)]))
    plans = []
    real = Versions._write

    def spy(self, df, write, gather):
        plans.append((gather, df._jdf.queryExecution().executedPlan().toString()))
        real(self, df, write, gather)

    monkeypatch.setattr(Versions, "_write", spy)
    store.merge(frame(spark, [(1, 1, "y")]), ["id"])
    store.merge(frame(spark, [(2, 1, "y")]), ["id"], "update", ["text"])
    kept = [p for gather, p in plans if not gather]
    assert len(kept) == 2 and all("BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p for p in kept)


def test_groups_of_buckets(spark, tmp_path):
    assert list(_groups({"0": 3, "1": 3, "2": 9, "3": 1, "4": 5}, 6)) == [(["0", "1"], True), (["2"], False), (["3", "4"], True)]
    stores = [table(spark, tmp_path / name) for name in "ab"]
    for store, limit in zip(stores, (1 << 20, 300)):  # one group, and groups of which some exceed the limit
        store.append(frame(spark, [(i, 0, "x") for i in range(80)]))
        store.merge(frame(spark, [(i, 1, "y") for i in range(40, 120)]), ["id"], broadcast=limit)
        store.merge(frame(spark, [(i, 1, "z") for i in range(0, 10)]), ["id"], "update", ["text"], broadcast=limit)
        store.merge(frame(spark, [(i, 1, "") for i in range(20, 30)]), ["id"], "delete", broadcast=limit)
    want = sorted([(i, 0, "z" if i < 10 else "x") for i in range(40) if not 20 <= i < 30] + [(i, 1, "y") for i in range(40, 120)])
    assert rows(stores[0]) == rows(stores[1]) == want


def test_two_writers(spark, tmp_path):
    """Both read version 1; one commits; the other is refused and changes nothing."""
    store, other = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    store.append(frame(spark, [(i, 0, "x") for i in range(20)]))
    base = other.snapshot()
    store.merge(frame(spark, [(1, 0, "first")]), ["id"])
    with pytest.raises(Conflict):
        other.replace(frame(spark, []), list(base.parts), base)
    assert len(rows(store)) == 20 and store.snapshot().version == 2
    other.append(frame(spark, [(100, 0, "appended")]))  # an append never contradicts
    assert len(rows(store)) == 21 and not list(pathlib.Path(tmp_path).rglob("*.tmp"))


def test_a_writer_that_loses_a_race_appends_later(spark, tmp_path, monkeypatch):
    store, other = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    real, raced = Versions.commit, []

    def commit(self, base, *args):
        if self is store and not raced:
            raced.append(other.append(frame(spark, [(2, 0, "other")])))
        return real(self, base, *args)

    monkeypatch.setattr(Versions, "commit", commit)
    store.append(frame(spark, [(1, 0, "mine")]))
    assert [r[0] for r in rows(store)] == [1, 2] and store.snapshot().version == 2


def test_replayed_batches_and_compaction(spark, tmp_path):
    store = table(spark, tmp_path / "t", 2)
    for batch in range(6):
        for _ in range(2):  # each batch comes twice
            store.append(frame(spark, [(batch * 10 + i, 0, "x") for i in range(10)]), ("stream", batch))
    store.append(frame(spark, [(1000, 0, "x")]), ("another", 0))
    assert len(rows(store)) == 61 and store.snapshot().batches == {"stream": 5, "another": 0}
    assert store.merge(frame(spark, [(0, 0, "y")]), ["id"], batch=("stream", 5)) is None
    assert max(len(w) for w in store.snapshot().parts.values()) >= 6
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # one scan, however many folders
    assert store.compact(4) == 2 and store.compact(4) == 0
    assert len(rows(store)) == 61 and {len(w) for w in store.snapshot().parts.values()} == {1}
    store.vacuum(hours=0)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and len(list((tmp_path / "t" / "log").glob("*.json"))) == 1


def test_parts_of_odd_values(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    store = Versions(spark, str(tmp_path / "t"), schema, "part", F.col("k"), T.StringType())
    data = [("a b/c=d:e", 1), (None, 2), ("x", 3), ("ü%41", 4)]
    store.append(spark.createDataFrame(data, schema))
    assert sorted((tuple(r) for r in store.read().select("k", "v").collect()), key=str) == sorted(data, key=str)
    assert store.read().where("part = 'x'").count() == 1 and store.read().where("part IS NULL").count() == 1
    ids = Versions.buckets(spark, str(tmp_path / "n"), SCHEMA, ["id"], 4)
    ids.append(frame(spark, [(None, 1, "a"), (1, 1, "b")]))
    ids.merge(frame(spark, [(None, 1, ""), (1, 1, "")]), ["id"], "delete")
    assert rows(ids) == [(None, 1, "a")]  # a null key names no row


def test_missing_rows(spark, tmp_path):
    """Buckets that the table lacks, groups that are broadcast, and larger buckets: the same rows, and no join per bucket."""
    store = table(spark, tmp_path / "t")
    asked = frame(spark, [(i, 1, "y") for i in range(40, 120)] + [(None, 1, "y")])
    assert store.missing(asked, ["id"]).count() == 81
    store.append(frame(spark, [(i, 0, "x") for i in range(80)]))
    for limit in (1 << 20, 1500, 300):
        fresh = store.missing(asked, ["id"], limit)
        assert sorted((r.id or 0) for r in fresh.collect()) == [0, *range(80, 120)]
        assert fresh.columns == SCHEMA.names
        assert fresh._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    some = table(spark, tmp_path / "some")
    some.append(frame(spark, [(1, 0, "x")]))
    assert sorted(r.id for r in some.missing(frame(spark, [(i, 0, "x") for i in range(9)]), ["id"]).collect()) == [0, *range(2, 9)]


def test_a_group_reads_its_own_buckets(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    pending, sizes = store._gathered(frame(spark, [(i, 0, "x" * 1000) for i in range(200)]), SCHEMA.names, ["id"])
    assert len(sizes) == 8 and sum(sizes.values()) < 200 * 100  # of the keys, not of the texts
    seen = [store._of(pending, [p]) for p in sizes]
    assert sum(x.count() for x in seen) == 200
    assert all("PartitionFilters: [isnotnull(bucket" in x._jdf.queryExecution().executedPlan().toString() for x in seen)
