"""The lexicon rules against a plain Python model of the published method, on random word salad."""

import math
import random
import string

from pyspark.sql import functions as F

from pressgauge.operators import sentiment as S

STRENGTH = {**{w: S.BOOST for w in S.BOOSTERS}, **{w: -S.BOOST for w in S.DAMPENERS}}


def model(text, lexicon):
    if not text:
        return 0.0
    words = []
    for token in text.split():
        bare = token.strip(string.punctuation)
        words.append(bare if len(bare) > 2 else token)
    low = [w.lower() for w in words]
    upper = sum(w.isupper() for w in words)
    mixed = 0 < upper < len(words)
    values = []
    for i, word in enumerate(words):
        if low[i] in STRENGTH or (low[i] == "kind" and low[i + 1 : i + 2] == ["of"]) or low[i] not in lexicon:
            values.append(0.0)
            continue
        v = lexicon[low[i]]
        if low[i] == "no" and i + 1 < len(words) and low[i + 1] in lexicon:
            v = 0.0
        back = lambda d: low[i - d] if i >= d else None
        if back(1) == "no" or back(2) == "no" or (back(3) == "no" and back(1) in ("or", "nor")):
            v = lexicon[low[i]] * S.NEGATE
        if word.isupper() and mixed:
            v += S.CAPS if v > 0 else -S.CAPS
        for d in (1, 2, 3):
            if i < d or back(d) in lexicon:
                continue
            s = 0.0
            if back(d) in STRENGTH:
                s = STRENGTH[back(d)] * (-1 if v < 0 else 1)
                if words[i - d].isupper() and mixed:
                    s += S.CAPS if v > 0 else -S.CAPS
            v += s * S.DISTANCE_DAMPING[d]
            negated = back(d) in S.NEGATIONS or "n't" in back(d)
            if d == 1:
                v *= S.NEGATE if negated else 1
            elif d == 2:
                if back(2) == "never" and back(1) in ("so", "this"):
                    v *= 1.25
                elif not (back(2) == "without" and back(1) == "doubt") and negated:
                    v *= S.NEGATE
            else:
                if (back(3) == "never" and back(2) in ("so", "this")) or back(1) in ("so", "this"):
                    v *= 1.25
                elif not (back(3) == "without" and "doubt" in (back(2), back(1))) and negated:
                    v *= S.NEGATE
                grams = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2)]
                said = [" ".join(low[i - a : i - b + 1]) for a, b in grams]
                v = next((S.IDIOMS[g] for g in said if g in S.IDIOMS), v)
                if len(words) - 1 > i:
                    v = S.IDIOMS.get(" ".join(low[i : i + 2]), v)
                if len(words) - 1 > i + 1:
                    v = S.IDIOMS.get(" ".join(low[i : i + 3]), v)
                for g in (said[3], said[4], said[2]):
                    v -= S.BOOST if g in S.DAMPENER_PHRASES else 0
        if back(1) == "least" and "least" not in lexicon and back(2) not in ("at", "very"):
            v *= S.NEGATE
        values.append(v)
    if "but" in low:
        at = low.index("but")
        values = [v * 0.5 if i < at else v * 1.5 if i > at else v for i, v in enumerate(values)]
    total = sum(values)
    marks = min(text.count("!"), 4) * 0.292
    asks = text.count("?")
    marks += 0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0
    total += marks if total > 0 else -marks if total < 0 else 0
    return round(total / math.sqrt(total * total + S.ALPHA), 4)


def test_random_texts(spark):
    rng = random.Random(7)
    pool = (
        "good bad great terrible no kind of sort but least at very so this never without doubt isn't not or nor "
        "the bus stop yeah right to die for best problem love hate really barely just enough broken heart nope"
    ).split()
    texts = []
    for _ in range(1500):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        words = [w.upper() if rng.random() < 0.12 else w + rng.choice(["", "", "", "!", "?", ",", "..."]) for w in words]
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.score for r in S.lexicon_scores(df, "id", "text", S.default_lexicon(spark)).collect()}
    wrong = [(t, got[i], model(t, S.DEFAULT_WORDS)) for i, t in enumerate(texts) if abs(got[i] - model(t, S.DEFAULT_WORDS)) > 1e-4]
    assert len(got) == len(texts) and not wrong, wrong[:3]


def test_empty_and_missing_text(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "   ")], "id int, text string")
    rows = S.lexicon_scores(df, "id", "text", S.default_lexicon(spark)).collect()
    assert {(r.id, r.score, r.label) for r in rows} == {(i, 0.0, "neutral") for i in (1, 2, 3)}


def test_label_edges(spark):
    rows = [("VADER", 0.05), ("vader", -0.05), ("VADER", 0.049), ("GCP_NL", 0.25), ("gcp_nl", -0.25), ("GCP_NL", 0.249), ("other", 0.05)]
    df = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(rows)], "i int, provider string, score double")
    got = [r.label for r in S.label_by_provider(df, S.providers(spark)).orderBy("i").collect()]
    assert got == ["positive", "negative", "neutral", "positive", "negative", "neutral", "positive"]


def test_fallback(spark):
    scored = spark.createDataFrame(
        [(1, False, 0.5, "positive"), (2, False, -0.5, "negative"), (3, True, 0.0, "neutral")], "k int, blank boolean, score double, label string"
    )
    model_scores = spark.createDataFrame([(1, -0.3, 0.9)], "k int, score double, magnitude double")

    def run(**kw):
        rows = S.sentiment_with_fallback(scored, model_scores, "k", **kw).orderBy("k").collect()
        return [(r.score, r.magnitude, r.label) for r in rows]

    assert run() == [(-0.3, 0.9, "negative"), (-0.5, None, "negative"), (0.0, None, "neutral")]
    assert run(fallback=False)[1] == (0.0, None, "neutral")
    assert run(provider="vader")[0] == (0.5, None, "positive")


def test_model_text_cut(spark):
    df = spark.createDataFrame([("é" * 10,), ("a" * 10,)], "t string")
    assert [r.x for r in df.select(S.model_text(F.col("t"), 12).alias("x")).collect()] == ["é" * 3, "a" * 10]


def test_read_lexicon(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("good\t1.9\t0.9\t[2, 2]\n:)\t2.0\t0.5\t[2]\n", encoding="utf-8")
    assert {tuple(r) for r in S.read_lexicon(spark, str(path)).collect()} == {("good", 1.9), (":)", 2.0)}
