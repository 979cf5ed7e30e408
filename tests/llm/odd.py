"""Rows that operators must take: nulls, empty and long texts, repeats, and columns whose names clash with their own."""

import random

EXTRA = "Row string, row_ string, contamination string, src string, size string, taken long, n long, id string, key string, lines string, dropped string, component string, place string, at string, score string, `kept 0` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
N_EXTRA = EXTRA.count(",") + 1


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "to", "in", "Straße", "été", "niño", "𝔘nicode", "é", "don't", "x9", "wind", "water"]
    return " ".join(rng.choice(words) + (rng.choice([".", ",", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def rows() -> list[tuple]:
    texts = [
        (None, prose(1, 60), "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", None),
        (4, "a", "fr", "b"), (5, prose(2, 60_000), "en", "a"), (6, prose(3, 80), "en", "b"), (7, prose(3, 80), "en", "b"),
        (7, prose(3, 80), "en", "b"), (8, "123 !!! ---", "de", "c"), (9, prose(4, 40) + "\n" + prose(3, 80) + "\n" + prose(4, 40), None, "a"),
        (10, "\n\n" + prose(3, 79) + " more\n", "en", "z"), (11, "漢字かな交じり文" * 50, "ja", "z"), (None, None, None, None), (None, prose(1, 60), "en", "a"),
    ]
    return [(k, t, g, s, len(t) if t is not None else None, *["x"] * 5, 7, 7, *["x"] * (N_EXTRA - 7)) for k, t, g, s in texts]


def documents(spark, kept=None):
    frame = spark.createDataFrame(rows() if kept is None else kept, SCHEMA)
    return frame.coalesce(1).sortWithinPartitions("doc_id", "text")
