"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing column names, for every operator and stage."""

import hashlib

import pytest
from odd import SCHEMA, documents, prose, rows
from pyspark.sql import functions as F

import corpus_pipeline
from pressgauge.llm import decontaminate, jaccard, language, licences, lines, mixing, quality, secrets, warc, winnow

IDS = sorted((r[0] for r in rows()), key=lambda k: (k is None, k))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    documents(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(3, 40)), (2, None), (3, "wind water"), (3, "wind water"), (None, prose(1, 30)), (4, "")]
    return spark.createDataFrame(items, "item_id long, text string")


def ids(frame, column="doc_id"):
    return sorted((r[column] for r in frame.select(column).collect()), key=lambda k: (k is None, k))


def test_quality(spark, odd, empty):
    trusted = odd.select("doc_id").where("doc_id IS NULL OR doc_id <> 4")
    model = quality.fit(quality.trusted_texts(odd, trusted))
    found = quality.perplexities(odd, model, ["doc_id", "lang", "src"])
    assert ids(found) == IDS and found.columns == ["doc_id", "lang", "src", "n_words", "perplexity"]
    by = {r["doc_id"]: r for r in found.collect() if r["doc_id"]}
    assert by[1]["perplexity"] is None is by[2]["perplexity"] is by[3]["perplexity"] and by[5]["n_words"] == 60_000 and by[5]["perplexity"] > 1
    judged = quality.judge(found, trusted)
    assert ids(judged) == IDS and not {1, 2, 3} & {r["doc_id"] for r in judged.where("rejected").collect()}
    kept = quality.accepted(odd, trusted)
    assert kept.columns == odd.columns and {1, 2, 3, 7} <= set(ids(kept))
    # nobody is trusted, nobody is there
    none = quality.accepted(odd, trusted.limit(0))
    assert ids(none) == IDS
    assert quality.accepted(empty, trusted).count() == 0 == quality.accepted(empty, trusted.limit(0)).count()


def test_decontamination(odd, empty, bench):
    for blocks in (1, 7):
        found, name = decontaminate.scan(odd, bench, max_windows=decontaminate.MAX_WINDOWS if blocks == 1 else 10)
        assert name not in odd.columns and found.columns == [*odd.columns, name]
        by = {}
        for r in found.collect():
            by.setdefault(r["doc_id"], []).append((r["text"], r[name]))
        assert len(by[7]) == 2 and by[7][0] == by[7][1]
        text, x = by[7][0]
        assert x["items"] == ["1"] and [(s["first_word"], s["last_word"]) for s in x["spans"]] == [(0, 40 + prose(3, 40).count("don't"))]
        assert text[x["spans"][0]["start"] : x["spans"][0]["end"]].startswith(prose(3, 39))
        assert by[1][0][1]["n_words"] == 0 and by[1][0][1]["spans"] == [] == by[2][0][1]["items"]
        assert by[None][0][1] is not None and any(v["spans"] and v["items"] == [] for _, v in by[None])  # hit by an item without id
        assert "3" in by[5][0][1]["items"]
    assert 7 not in ids(decontaminate.clean_documents(odd, bench)) and 8 in ids(decontaminate.clean_documents(odd, bench))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean_spans(odd, bench).collect()}
    assert cut[1] is None and cut[4] == "a" and not cut[7].startswith(prose(3, 10)) and cut[7].endswith(prose(3, 80)[-20:])
    assert ids(decontaminate.clean_documents(odd, bench.limit(0))) == IDS
    assert decontaminate.clean_documents(empty, bench).count() == 0


def test_language(odd, empty):
    model = language.fit(odd, F.col("text"), F.col("lang"), F.col("doc_id"))
    found = language.predict(odd, model, ["doc_id", "score", "lang"])
    assert ids(found) == IDS and found.columns == ["doc_id", "score", "lang", "lang_pred", "score"]
    got = language.predict(odd, model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3, 8))
    assert by[11]["lang_pred"] == "ja" and by[5]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    nothing = language.fit(empty, F.col("text"), F.col("lang"), F.col("doc_id"))
    assert {r["lang_pred"] for r in language.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.predict(empty, model, ["doc_id"]).count() == 0


def test_secrets(odd, empty):
    ratios = secrets.transitions(secrets.samples_of(odd))
    found = secrets.scan(odd, ratios, ["doc_id", "kept 0", "Row"])
    assert ids(found) == IDS and found.columns == ["doc_id", "kept 0", "Row", "found"]
    assert all(r["found"] == [] for r in found.where("doc_id IN (1, 2, 3, 4)").collect())
    assert secrets.scan(empty, secrets.transitions(secrets.samples_of(empty)), ["doc_id"]).count() == 0


def test_mixing(odd, empty):
    found = mixing.Mix(odd, ["doc_id", "size", "taken"], block=8, shard=16).taken()
    assert ids(found) == IDS
    plain = mixing.Mix(odd, ["doc_id", "source"], block=8, shard=16).taken().collect()
    assert sum(r["taken"] for r in plain if r["doc_id"] in (1, 2, 3)) == 0 and all(r["taken"] <= 3 * r["size"] for r in plain)
    assert {r["source_size"] for r in plain if r["source"] is None} == {0}
    blocks = mixing.mixed_blocks(odd, block=8, shard=16)
    assert sum(len(r["text"].split()) for r in blocks.collect()) > 1000
    assert mixing.Mix(empty, ["doc_id"]).taken().count() == 0 == mixing.mixed_blocks(empty).count()
    # a source far below its share stops at three times its size
    small = odd.where("doc_id IN (4, 5)")
    by = {r["doc_id"]: r for r in mixing.Mix(small, ["doc_id"], block=8, shard=16).taken().collect()}
    assert by[4]["target"] == 3.0 and by[4]["taken"] <= 3 and by[5]["target"] == pytest.approx(60_001 - 3)


def test_winnowing(odd, empty):
    found = winnow.compared(odd)
    assert ids(found) == IDS
    texts = {}
    for r in rows():
        texts[(r[0], r[1] or "")] = None
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), ))
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[7]) == 2 and by[7][0] == by[7][1]
    after = dict(zip([k for k, _ in order if k], [t for _, t in order][1:]))
    for k, t in order:
        if k and k != 1:  # what follows the last id is one of several rows without
            half = len(t) // 2
            assert by[k][0]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[k][:half]).encode()).hexdigest(), k
    assert by[1][0]["fingerprint"] == "" == by[2][0]["fingerprint"] == by[3][0]["fingerprint"] and by[2][0]["near_next"] == 1.0
    assert by[6][0]["fingerprint"] == by[7][0]["fingerprint"] != "" and by[7][0]["near_next"] == 1.0
    assert winnow.compared(empty).count() == 0
    one = winnow.compared(odd.where("doc_id = 6")).first()
    assert one["near_next"] == 1.0


def test_licences(spark, odd, empty):
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and "granted" in t)
    cases = [
        (1, "LICENSED under the *Apache* Licence,  version 2.0"), (2, "Copyright (c) 2020 Somebody\n" + mit.upper()), (3, None), (4, ""),
        (5, "text\nLicensed under CC BY 4.0.\ntext"), (5, "Licensed under the Apache License, Version 2.0, or not."), (6, "Copyright 1999"),
        (7, "intro\n\n" + mit.replace(". ", ".\n") + "\n\nend"),
    ]
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in cases], "doc_id long, text string, whole string, row string")
    found = sorted(licences.scan(frame, licences.known(spark), ["doc_id"]).collect())
    assert [(r["doc_id"], r["whole"], r["parts"]) for r in found] == [
        (1, ["Apache-2.0"], ["Apache-2.0"]), (2, ["MIT"], ["MIT"]), (3, [], []), (4, [], []), (5, [], []), (5, [], ["CC-BY-4.0"]), (6, [], []), (7, [], ["MIT"]),
    ]
    assert licences.scan(frame, licences.known(spark), ["doc_id", "whole"]).columns == ["doc_id", "whole", "whole", "parts"]
    assert ids(licences.scan(odd, licences.known(spark), ["doc_id"])) == IDS
    assert licences.scan(empty, licences.known(spark), ["doc_id"]).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 7}/{i}", "x" * (i * 37 % 90_000), "clash") for i in range(600)] + [(5, "http://h5/5", "x" * 185, "clash"), (None, None, None, None)],
        "page_id long, url string, html string, offset string",
    )
    stock = warc.records(pages, "page_id", "url", "html").withColumn("extra", F.lit(1))
    assert stock.count() == 602
    whole = warc.tree(stock, "a")
    assert len(whole) >= 3 and warc.audit(whole, whole).count() == 0
    bad = stock.where("record_id IS NULL OR record_id <> 77").withColumn("content", F.when(F.col("record_id") == 300, F.lit(None)).when(F.col("record_id") == 12, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")))
    got = {(r["kind"], r["record_id"]) for r in warc.audit(whole, warc.tree(bad, "b")).collect()}
    assert got == {("missing", 77), ("changed", 300), ("changed", 12)}
    assert {r["kind"] for r in warc.audit(warc.tree(bad, "b"), whole).collect()} == {"added", "changed"}
    none = warc.tree(stock.limit(0), "none")
    assert warc.audit(whole, none).count() == 602 and warc.audit(none, none).count() == 0
    twice = warc.tree(stock.where("file = 0").unionByName(stock.where("file = 0")), "twice")
    assert {r["kind"] for r in warc.audit(twice, warc.tree(stock.where("file = 0"), "once")).collect()} == {"missing"}


def test_jaccard(odd, empty):
    numbered, found, row = jaccard.classes(odd)
    assert row.lower() not in [c.lower() for c in odd.columns]
    by = {}
    for r in found.collect():
        by.setdefault(r["key"], []).append((r["n"], r["component"]))
    assert sorted(by, key=lambda k: (k is None, k)) == sorted(set(IDS), key=lambda k: (k is None, k)) and len(by[7]) == 2 and len(by[None]) == 3
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(1, 4)]
    assert by[7][0][1] == 6 == by[6][0][1] == by[10][0][1] and by[9][0][1] == 9
    assert sorted(by[None], key=str) == sorted([(0, None), (56, None), (56, None)], key=str)
    kept = jaccard.distinct_documents(odd)
    assert kept.columns == odd.columns and set(ids(kept)) == {1, 2, 3, 4, 5, 6, 8, 9, 11, None} and kept.where("doc_id IS NULL").count() == 2
    assert jaccard.distinct_documents(empty).count() == 0


def test_jaccard_groups_and_chains(spark, tmp_path):
    """A chain of ever more edited copies, links only between neighbours; a large group of one text and its near copies."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts, chain = [], list(base)
    for step in range(8):
        texts.append(" ".join(chain))
        for i in range(step * 3, step * 3 + 3):
            chain[i * 8 % 200] = f"new{step}{i}"
    for i in range(1200):
        near = ["g", *base[50:], *(f"tail{k}" for k in range(50))]
        near[rng.randrange(150)] = f"x{rng.randrange(400)}"
        texts.append(" ".join(near))
    texts += [" ".join(f"u{k}_{i}" for i in range(30)) for k in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3).write.parquet(str(tmp_path / "d"))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root(i) != root(j) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    _, found, _ = jaccard.classes(spark.read.parquet(str(tmp_path / "d")))
    assert {r["key"]: r["component"] for r in found.collect()} == {i: root(i) for i in range(len(texts))}


def test_lines(spark, odd, empty, tmp_path):
    cleaned = lines.dedup(odd, counts=True)
    assert cleaned.columns == [*odd.columns, "n_lines", "n_dropped"] and ids(cleaned) == IDS
    by = {}
    for r in cleaned.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0 and by[2][0]["text"] == "" and by[4][0]["text"] == "a" and by[3][0]["text"] == " \t\n "
    assert by[6][0]["n_dropped"] == 0 and [r["text"] for r in by[7]] == ["", ""] and by[9][0]["text"] == prose(4, 40)
    assert by[10][0]["text"] == "\n\n" and sorted(r["n_dropped"] for r in by[None]) == [0, 0, 1]
    assert lines.dedup(empty).count() == 0
    # many copies of one line in one text and over texts, on either side of the similarity
    words = [f"word{i}" for i in range(40)]
    variants = [" ".join([*words[:k], f"other{k}", *words[k + 1 :]]) for k in range(40)]
    spark.createDataFrame([(i, "\n".join(variants[i % 40 : i % 40 + 3])) for i in range(300)], "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "l"))
    kept = "\n".join(r["text"] for r in lines.dedup(spark.read.parquet(str(tmp_path / "l"))).collect() if r["text"]).split("\n")
    assert kept == [variants[0]]


def test_stages(spark, odd, empty, bench, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, sf)
            if name != "mixing":
                assert out.columns == odd.columns, name
            assert out.count() == 0 if docs is empty else out.count() > 0, name
