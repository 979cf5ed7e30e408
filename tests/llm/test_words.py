import re

import numpy as np
import pyarrow as pa
from odd import rows

from pressgauge.llm.words import LONG_WORD, PUNCT, SPACE, Lookup, Words, grams, portions, powers, within

TEXTS = [r[1] for r in rows()] + ["w" * 300 + " " + "w" * 300 + " end", "", None, "end"]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_are_those_of_the_patterns():
    for table, pattern in ((SPACE, r"[^\x20\x09-\x0D]+"), (PUNCT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for column in (pa.array(TEXTS), pa.array(TEXTS)[3:], pa.array(TEXTS, pa.large_string())):
            w = Words(column, table, lower=True)
            found = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
            wanted = [re.findall(pattern, low(t)) for t in column.to_pylist()]
            assert list(w.counts) == [len(x) for x in wanted]
            assert found == [x for ws in wanted for x in ws]


def test_equal_words_and_only_those_have_equal_hashes():
    w = Words(pa.array(TEXTS), SPACE)
    words = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    by_word = {}
    for word, h in zip(words, w.hashes()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert any(len(x) > LONG_WORD for x in words)


def test_grams_stay_within_texts():
    w = Words(pa.array(["a b c", "d e", "a b c"]), SPACE)
    g = grams(w.hashes(), 3)
    assert list(within(w, 3)) == [True, False, False, False, False, True]
    assert g[0] == g[5] and len(set(g)) == 5


def test_portions_cover_all_rows():
    for limit in (1, 100, 1 << 30):
        cut = list(portions(pa.array(TEXTS), limit))
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(TEXTS)))
    assert list(portions(pa.array([], pa.string()))) == []


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    crowded = np.unique(np.concatenate([keys, keys[:50] ^ np.uint64(1)]))
    look = Lookup(crowded, 12)
    assert (look.find(crowded) == np.arange(len(crowded))).all()
    assert (look.find(crowded ^ np.uint64(1 << 20)) == -1).all()
    assert (Lookup(keys[:0]).find(keys) == -1).all()


def test_powers_undo_each_other():
    assert (powers("up", 1000)[:1000] * powers("down", 1000)[:1000] == 1).all()
