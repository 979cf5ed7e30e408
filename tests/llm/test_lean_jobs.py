"""Work is done once, and what a step leaves on disk goes before the next step."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import components, lines, quality, queries, sketches, winnow
from pressgauge.llm.frames import table

SF = "/root/testdata/sf0.001"


def test_runs_take_word_hashes_once(spark):
    hashes = winnow.word_hashes(F.col("text"))
    runs = winnow._runs(hashes, winnow.K)
    assert str(runs).count(str(hashes)[8:-2]) == 1  # and not again for each run
    assert "array_min" not in str(winnow.fingerprint(F.col("text")))  # no window is looked through word by word


@pytest.mark.parametrize("k, w", [(winnow.K, winnow.W), (1, 1), (3, 7), (5, 16)])
def test_fingerprints_of_every_length(spark, k, w):
    texts = [" ".join(f"w{i * i % 11}" for i in range(n)) for n in range(45)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in frame.select("id", winnow.word_hashes(F.col("text")).alias("h"), winnow.fingerprint(F.col("text"), k, w).alias("p")).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        assert len(got[i]["h"]) == len(words) and len(set(got[i]["h"])) == len(set(words))
        n = max(1, len(words) - k + 1) if words else 0
        pieces = [" ".join(words[j : j + k]) for j in range(n)]
        frames = spark.createDataFrame([(j, p.split()) for j, p in enumerate(pieces)], "j int, p array<string>")
        runs = [r["g"] for r in frames.orderBy("j").select(F.xxhash64(F.transform("p", lambda x: F.xxhash64(x))).alias("g")).collect()] if i % 7 in (1, 5) and n else None
        if runs:
            kept = set()
            for low in range(max(1, n - w + 1)):
                kept.add(min(range(low, min(low + w, n)), key=lambda j: ((runs[j] % 2**64) >> 33, -j)))
            assert [(p["hash"], p["position"]) for p in got[i]["p"]] == [(runs[j], j) for j in sorted(kept)]


def test_words_of_unusual_texts(spark):
    texts = ["a" * 32 + " b", "a" * 33 + " b", "b " + "é" * 33, "—" * 30 + " x", "日本 word", "x’s 日", "\t" + "z" * 40 + "\n", "𠀀𠀁 b"]
    counts = [2, 34, 34, 2, 3, 2, 40, 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r[0] for r in frame.orderBy("id").select(F.size(winnow.word_hashes(F.col("text")))).collect()] == counts


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getPath(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_quality_leaves_little_on_disk(spark):
    """Tables and shuffle files of the model are gone when its query returns, and it sends no files of a whole bit map."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    had, tables, sent = shuffled(spark), set(os.listdir(root)), []
    broadcast = spark.sparkContext.broadcast
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(broadcast(value)) or sent[-1])
        scores = queries.QUERIES["op1_quality"](spark, SF)
    made = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - tables}
    assert not made & {"words", "bigrams", "contexts", "endings", "gains", "terms", "tail"} and "perplexities" in made
    assert sum(size for path, size in shuffled(spark).items() if path not in had) < 200_000
    assert len(sent) > 3 and all(len(pa.py_buffer(x)) < 1 << 22 for s in sent if s._path and os.path.exists(s._path) for x in [open(s._path, "rb").read()])
    assert scores.count() == table(spark, SF, "documents").count()


def test_perplexities_in_slices(spark):
    docs = table(spark, SF, "documents")
    docs = docs.union(docs.limit(40)).union(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    model = quality.fit(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), "text"), hot=50, hot_words=100, least=1)
    whole = quality.perplexities(docs, model, ["doc_id", "text"]).toPandas()
    parts = quality.perplexities(docs, model, ["doc_id", "text"], slice_bytes=1, spend=True).toPandas()
    for frame in (whole, parts):
        frame.sort_values(["doc_id", "n_words"], inplace=True)
    assert len(whole) == docs.count() and (whole["n_words"].to_numpy() == parts["n_words"].to_numpy()).all()
    assert np.allclose(whole["perplexity"], parts["perplexity"], rtol=1e-5, equal_nan=True)


def plans_of(patch, module):
    """Plans of the tables that a module's steps write, by name, as they are written."""
    plans, write = {}, module.stored

    def stored(df, name, **options):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **options)

    patch.setattr(module, "stored", stored)
    return plans


def test_table_of_counts_is_shuffled_once(spark):
    """Not again for each slice of texts; and one Python step reads the trusted texts, which are not shuffled."""
    with pytest.MonkeyPatch.context() as patch:
        plans = plans_of(patch, quality)
        docs = table(spark, SF, "documents")
        model = quality.fit(quality.trusted_texts(docs, queries.trusted(spark, SF)), hot=50, hot_words=100, least=1)
        quality.perplexities(docs, model, ["doc_id"], slice_bytes=1)
    assert len(plans["perplexities"]) == quality.SLICES
    assert all(plan.count("Exchange hashpartitioning(shard") == 1 for plan in plans["perplexities"])
    for plan in plans["words"] + plans["bigrams"]:
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("bits, few", [(1 << 27, 1 << 22), (1 << 6, 1 << 22), (1 << 6, 0)])
def test_trusted_texts(spark, monkeypatch, bits, few):
    """The same ones whether other keys hit their bits or not, and however many do."""
    monkeypatch.setattr(quality, "BITS", bits)
    monkeypatch.setattr(quality, "FEW_LURES", few)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.union(docs.limit(9)).union(spark.createDataFrame([(None, "no key"), (3, None)], docs.schema))
    trusted = queries.trusted(spark, SF).union(spark.createDataFrame([(None,), (10**9,)], "doc_id long"))
    mine = {r[0] for r in trusted.where(~quality.is_held_out(F.col("doc_id"))).collect()}
    wanted = sorted((r[0], r[1]) for r in docs.collect() if r[0] in mine and r[0] is not None and r[1] is not None)
    texts = quality.trusted_texts(docs, trusted)
    assert wanted and sorted(map(tuple, texts.collect())) == wanted
    if few:
        rows, chosen = texts.made_of
        assert "hash" in rows.columns and "text" in rows.columns and rows.count() > len(wanted)
    model, plain = (quality.fit(x, hot=50, hot_words=100, least=1) for x in (texts, spark.createDataFrame(wanted, "key long, text string")))
    assert (model["hot"] == plain["hot"]).all() and np.allclose(model["gain"], plain["gain"])
    assert (model["keys"] == plain["keys"]).all() and np.allclose(model["lowest"], plain["lowest"])


def test_lines_leave_little_on_disk(spark):
    """Before the texts are joined with the lines to drop, the lines, their texts and their shuffle files are gone."""

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    had, tables = shuffled(spark), set(os.listdir(root))
    cleaned = lines.dedup(table(spark, SF, "documents"), short=True)
    made = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - tables}
    assert not made & {"line-rows", "lines", "tiles", "mixed", "pairs", "links"} and "drops" in made
    left = sum(size for path, size in shuffled(spark).items() if path not in had)
    assert left < 200_000, left
    assert cleaned.count() == table(spark, SF, "documents").count()


def test_lines_are_shuffled_once(spark):
    """Pairs come to them, where they are in buckets; their bands are gone when the tiles are stored."""
    root, live = spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), []
    tables, had, line_texts = {t.name for t in spark.catalog.listTables()}, set(os.listdir(root)), lines.line_texts
    with pytest.MonkeyPatch.context() as patch:
        plans = plans_of(patch, components)
        patch.setattr(lines, "line_texts", lambda *a: live.append(set(os.listdir(root)) - had) or line_texts(*a))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            cleaned = lines.dedup(table(spark, SF, "documents"), short=True)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    verified = [p for p in plans["links"] if "MapInArrow exact" in p]
    assert len(verified) == 4 and all(p.count("Bucketed: true") == 4 for p in verified)
    for plan in verified + [p for p in plans["pairs"] if "MapInArrow compared" in p]:
        above = [x.lstrip(" :+-") for x in plan.splitlines()]
        scans = [i for i, x in enumerate(above) if "Bucketed: true" in x]
        assert scans and not any("Exchange" in x for i in scans for x in above[i - 3 : i]), plan
    assert live and not any(n.startswith("line-bands") for n in live[0])
    assert {t.name for t in spark.catalog.listTables()} == tables  # the table in buckets is gone from the catalog too
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1  # a text is split once, not again for each of its lines


def test_texts_of_many_lines(spark):
    texts = ["\n".join(f"line {i % 7000} of a long text" if i % 3 else "" for i in range(20_000)), None, "", "a\n\nline 5 of a long text\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    drops = spark.createDataFrame([(0, list(range(7000, 20_000)))], "doc_id int, dropped array<int>")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lines, "repeated", lambda *a: (frame, drops.withColumnRenamed("doc_id", "row"), "doc_id"))
        got = {r[0]: r[1] for r in lines.dedup(frame).collect()}
    assert got == {0: "\n".join(texts[0].split("\n")[:7000]), **dict(list(enumerate(texts))[1:])}


@pytest.mark.parametrize("every", [True, False])
def test_small_tiles_at_once(monkeypatch, every):
    """The pairs that tiles give one by one, less some whose own maps show them to be unlike; none that is alike is lost."""
    random, rows = np.random.default_rng(8), []
    for tile in range(60):
        base = random.integers(0, 1 << 62, 5 + tile * 4, dtype=np.uint64)
        for i in range(int(random.integers(1, 12))):
            own = np.unique(np.concatenate([base[random.random(len(base)) < 0.97], random.integers(0, 1 << 62, int(random.integers(0, 3)) * (1 + tile // 2), dtype=np.uint64)]))
            rows.append((tile, 0, 0, 0, tile * 100 + i, int(random.integers(0, 4)), len(own), sketches.sketch(own, 1), own))
    kinds = {"tile": pa.int64(), "low": pa.int64(), "high": pa.int64(), "block": pa.int64(), "id": pa.int64(), "component": pa.int64(), "n": pa.int64(), "sketch": pa.binary()}
    frame = pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))
    edges = [0, *(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]), len(rows)]
    found = {}
    for most in (0, 64):
        monkeypatch.setattr(components, "SMALL", most)
        found[most] = {(r["x"], r["y"]) for b in components._block_pairs(frame, edges, 80, every) for r in b.to_pylist()}
    alike = {(a[4], b[4]) for a in rows for b in rows if a[0] == b[0] and a[4] < b[4] and a[5] != b[5] and 100 * (k := len(np.intersect1d(a[8], b[8]))) >= 80 * (a[6] + b[6] - k)}
    assert len(alike) > 100
    if every:
        assert alike <= found[64] <= found[0]
    else:
        assert 60 < len(found[64]) and len(found[64] & found[0]) > 0.8 * len(found[0])
    for i, j in zip(*random.integers(0, len(rows), (2, 300))):
        maps = np.array([rows[i][7], rows[j][7]], object)
        assert sketches.differing(maps, np.array([0]), np.array([1]))[0] == sketches.apart(*maps)


def test_maps_of_lines_are_small():
    """Many at a time they are those of one at a time; a map has less than two bits a shingle, beyond the least."""
    random = np.random.default_rng(4)
    texts = ["", "a", "abcd", "abcde", "aaaaaaaaaaaa", "日本語の長い行です", *("".join(random.choice(list("abcdefgh é"), n)) for n in (30, 64, 70, 300, 3000))]
    members, bounds = lines.shingle_runs(pa.array(texts))
    for text, low, high in zip(texts, bounds, bounds[1:]):
        assert high - low == (len({text[i : i + 5] for i in range(len(text) - 4)}) or bool(text))
        assert (np.diff(members[low:high].astype(object)) > 0).all()
    for spread in (1, 4):
        maps = sketches.sketches(members, bounds, spread)
        assert maps == [sketches.sketch(members[low:high], spread) for low, high in zip(bounds, bounds[1:])]
    maps = sketches.sketches(members, bounds, lines.SPREAD)
    assert all(8 * len(x) < max(sketches.LEAST + 1, 2 * n) for x, n in zip(maps, np.diff(bounds)))


def test_texts_stay_where_they_are_for_the_rejected(spark):
    """The first stage's texts are not shuffled to leave out a few rows, and those are the ones that op1_quality rejects."""
    docs = table(spark, SF, "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = quality.accepted(docs, queries.trusted(spark, SF))
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        left = sorted(r[0] for r in kept.select("doc_id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scores = queries.QUERIES["op1_quality"](spark, SF)
    assert 0 < len(left) < docs.count() and left == sorted(r[0] for r in scores.where("NOT rejected").select("doc_id").collect())
