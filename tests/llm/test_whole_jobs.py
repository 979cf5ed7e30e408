"""Operators do the whole job: no cap on the vocabulary, no pruning, no line or text too short to be seen."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_queries import SF, kneser_ney

from pressgauge.llm import licences, lines, quality, winnow
from pressgauge.llm.queries import QUERIES, trusted


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def scored(spark, docs, **options):
    train = docs[docs.doc_id % 2 == 0]
    model = quality.fit(spark.createDataFrame(train[["doc_id", "text"]].rename(columns={"doc_id": "key"})), **options)
    found = quality.perplexities(spark.createDataFrame(docs), model, ["text"]).collect()
    return [words(t) for t in train.text], {r["text"]: r["perplexity"] for r in found}


def test_vocabulary_has_no_limit(spark, docs):
    """Words beyond those that are broadcast keep their own counts."""
    train, found = scored(spark, docs, hot=50, hot_words=20)
    plain = kneser_ney(train, None)
    assert len(found) > 100
    for text, perplexity in found.items():
        assert perplexity == pytest.approx(plain(words(text)), rel=1e-6)


def test_words_that_only_seem_known(spark, docs):
    """A crowded bit map changes nothing."""
    train, found = scored(spark, docs, hot=50, hot_words=20, size=1 << 15)
    plain = kneser_ney(train, None)
    for text, perplexity in found.items():
        assert perplexity == pytest.approx(plain(words(text)), rel=1e-6)


def unpruned(train):
    """Kneser-Ney with all bigrams: every count is discounted, and only what the discounts take backs off."""
    counts = Counter(w for t in train for w in t)
    kept = {w for w, n in counts.items() if n > 1}
    rare = max(1, len(counts) - len(kept))

    def sent(text):
        return ["<s>", *[w if w in kept else "<unk>" for w in text]]

    pairs = Counter(p for t in train for p in zip(sent(t), sent(t)[1:]))
    of = Counter(pairs.values())
    d = quality._discounts([of.get(i, 0) for i in (1, 2, 3, 4)])
    total, taken, ended = Counter(), defaultdict(float), Counter()
    for (u, v), n in pairs.items():
        total[u] += n
        taken[u] += d[min(n, 3) - 1]
        ended[v] += 1
    of = Counter(ended.values())
    e = quality._discounts([of.get(i, 0) for i in (1, 2, 3, 4)])
    mass = sum(ended.values())
    cut = {v: max(n - e[min(n, 3) - 1], 0) for v, n in ended.items()}
    floor = (mass - sum(cut.values())) / (len(kept) + 2)

    def perplexity(text):
        s, log = sent(text), 0.0
        for u, v in zip(s, s[1:]):
            n = pairs.get((u, v), 0)
            back = taken[u] / total[u] if total[u] else 1.0
            p = back * (cut.get(v, 0) + floor) / mass + (max(n - d[min(n, 3) - 1], 0) / total[u] if n else 0)
            log += math.log(p) - (math.log(rare) if v == "<unk>" else 0)
        return math.exp(-log / len(text)) if text else None

    return perplexity


def test_bigrams_seen_once_count(spark, docs):
    train, found = scored(spark, docs, hot=50, hot_words=20, least=1)
    plain = unpruned(train)
    for text, perplexity in found.items():
        assert perplexity == pytest.approx(plain(words(text)), rel=1e-6)


def test_query_prunes_nothing(spark, docs):
    good = {r["doc_id"] for r in trusted(spark, SF).collect()}
    ids = spark.createDataFrame(docs[["doc_id"]])
    held = {r["doc_id"] for r in ids.where(quality.is_held_out(ids.doc_id)).collect()}
    plain = unpruned([words(t) for k, t in zip(docs.doc_id, docs.text) if k in good - held])
    texts = dict(zip(docs.doc_id, docs.text))
    for r in QUERIES["op1_quality"](spark, SF).collect():
        assert r["perplexity"] == pytest.approx(plain(words(texts[r["doc_id"]])), rel=1e-6)


def left(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(lines.dedup(frame, **options).collect(), key=lambda r: r["doc_id"])]


def test_one_edit_in_a_line_of_sixty(spark):
    """One changed character leaves (L - 9) / (L + 1) of the shingles."""
    line = "the quick brown fox jumps over the lazy dog by winter rivers"
    assert len(line) == 60 and left(spark, [line, line[:30] + "#" + line[31:], line[::-1]]) == [line, "", line[::-1]]


def test_short_lines(spark):
    texts = ["Ietzte.\nOf.\n \n目\n\nnew", "Ietzte.\nof.\n \n目\n\nold", "x\n日\nOf!"]
    assert left(spark, texts, short=True) == ["Ietzte.\nOf.\n \n目\n\nnew", " \n\nold", "x\n日\nOf!"]
    assert left(spark, texts) == ["Ietzte.\nOf.\n \n目\n\nnew", "of.\n \n目\n\nold", "x\n日\nOf!"]


def test_entire_licences(spark):
    texts = dict(licences.entire())
    bare = texts["MIT"].split("\n\n", 1)[1]
    cases = [("whole", n, t) for n, t in texts.items()] + [
        ("whole", "MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + bare), ("whole", "MIT", bare),
        ("whole", "Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0]),
        ("parts", "MIT", "# Project\n\nSome words.\n\n## License\n\n" + bare + "\nMore words."),
        ("parts", "GPL-3.0", "Preface of our own\n\n" + texts["GPL-3.0"] + "\n\nafterword"),
        ("none", "", "Some words.\n\n" + bare.rsplit("\n\n", 1)[0]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.scan(frame, licences.known(spark), ["doc_id"]).collect()}
    for i, (where, name, _) in enumerate(cases):
        assert [r for r in ("whole", "parts") if name in found[i][r]][:1] == [where] if name else found[i]["parts"] == [] == found[i]["whole"], (where, name)


def test_licence_table_as_input(spark):
    text = "House License\n\n" + "You may read this text on every day of the week but one.\n\n" * 2 + "You may not sell any part of it to anybody else at any time."
    rules = licences.known(spark, spark.createDataFrame([("House", text)], "licence string, text string"))
    frame = spark.createDataFrame([(1, text.split("\n\n", 1)[1]), (2, "a\n\n" + text)], "doc_id long, text string")
    found = {r["doc_id"]: (r["whole"], r["parts"]) for r in licences.scan(frame, rules, ["doc_id"]).collect()}
    assert found == {1: (["House"], ["House"]), 2: ([], ["House"])}


@pytest.mark.parametrize("alphabet", ["目山水火木金土日月年人口大小中", "กขคงจฉชซฌญฎฏฐ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
def test_text_without_spaces_shares_fingerprints(spark, alphabet):
    import random

    draw = random.Random(5)
    shared, one, two = ("".join(draw.choices(alphabet, k=300)) for _ in range(3))
    row = spark.createDataFrame([(shared + one, shared + two, one)], "a string, b string, c string")
    a, b, c = (winnow.fingerprint(F.col(x)) for x in "abc")
    near, far = row.select(winnow.likeness(a, b), winnow.likeness(b, c)).first()
    assert 0.2 < near < 0.6 and far < 0.1
