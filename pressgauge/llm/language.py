"""Language identification by words first, then by ever shorter character n-grams.

A text's words are runs of Unicode letters and marks, in lower case. A word the model knows scores its log frequency in
each language. For any other word the longest character n-grams (MAX_N letters) the model knows count instead; if it
knows none of that length, those one letter shorter, down to single letters. The language with the highest sum of scores
and log prior wins, ties by code point; ``score`` is its share of the posterior.

The model is fitted on at most about ``max_docs`` labelled texts (chosen by a hash of the key) and keeps the ``max_words``
commonest words and ``max_grams`` commonest n-grams of each length: that bounds what is broadcast.

Null texts and texts without a letter give ``und`` and 0; so does everything when nothing was learned. Null labels are
not learned from. Each row is judged by itself, so repeated rows get equal answers.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .words import Lookup, mix, portions, runs, text_buffers

MAX_N = 4
LONGEST = 64  # longer runs of letters are scored by n-grams only
UNKNOWN = "und"


@cache
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: letter, letter or mark, and a random value of its lower case."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.fromiter((k == "L" for k in kinds), bool, 0x110000)
    word = letter | np.fromiter((k == "M" for k in kinds), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint64)
    for i in np.flatnonzero(letter):
        if len(small := chr(i).lower()) == 1:
            lower[i] = ord(small)
    return letter, word, mix(lower + np.uint64(1))


def _fold(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + values[at + k]
    return mix(out)


class Spelling:
    """Words and character n-grams of some texts."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        letter, word, values = letters()
        self.values = values[codes]
        inside = word[codes]
        places = heads[offsets]
        self.starts, self.ends, self.bounds = runs(inside, places)
        self.size = self.ends - self.starts
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        any_letter = np.concatenate([[0], np.cumsum(letter[codes])])
        self.lettered = any_letter[places[1:]] > any_letter[places[:-1]]

    def words(self) -> np.ndarray:
        """A hash for each word; 0 for those longer than LONGEST."""
        out = np.zeros(len(self.starts), np.uint64)
        for n in np.unique(self.size[self.size <= LONGEST]):
            those = np.flatnonzero(self.size == n)
            out[those] = _fold(self.values, self.starts[those], int(n))
        return out

    def grams(self, those: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some words, and for each its word."""
        count = np.maximum(self.size[those] - n + 1, 0)
        word = np.repeat(those, count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + self.starts[word]
        return _fold(self.values, at, n), word


def fit(docs: DataFrame, text: Column, lang: Column, key: Column, max_docs: int = 20_000, max_words: int = 50_000, max_grams: int = 50_000) -> dict:
    """The model, as arrays on the driver: at most ``max_words`` + MAX_N * ``max_grams`` features by languages."""
    spark = docs.sparkSession
    known = docs.where(lang.isNotNull() & text.isNotNull()).select(lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(key.cast("string")).alias("draw"))
    priors = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    share = min(1.0, max_docs / max(1, sum(priors.values())))
    if share < 1:
        known = known.where(F.col("draw") < int((share - 0.5) * 2**64))

    def counted(batches):
        for batch in batches:
            for low, high in portions(batch.column(1)):
                names = batch.column(0)[low:high].to_numpy(zero_copy_only=False)
                s = Spelling(batch.column(1)[low:high])
                everything = np.arange(len(s.starts))
                for n in range(MAX_N + 1):
                    hashes, word = (s.words(), everything) if n == 0 else s.grams(everything, n)
                    spoken = names[s.text[word]] if len(word) else np.zeros(0, object)
                    for name in set(names):
                        found, times = np.unique(hashes[spoken == name], return_counts=True)
                        those = found != 0
                        m = int(those.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * m, pa.string()), pa.array(np.full(m, n, np.int32)), pa.array(found[those].view(np.int64)), pa.array(times[those])],
                            names=["lang", "n", "hash", "times"],
                        )

    counts = (
        known.select("lang", "text").mapInArrow(counted, "lang string, n int, hash long, times long")
        .groupBy("n", "hash", "lang").agg(F.sum("times").alias("times"))
        .groupBy("n", "hash").agg(F.sum("times").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("by_lang"))
        .where("n > 0 OR total > 1")
    )
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("total"), "hash"))
    top = counts.withColumn("rank", rank).where((F.col("rank") <= max_grams) & ((F.col("n") > 0) | (F.col("rank") <= max_words)))
    rows = top.select("n", "hash", *[F.coalesce(F.col("by_lang")[x], F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)]).toPandas() if langs else None
    tables = []
    for n in range(MAX_N + 1) if langs else ():
        part = rows[rows["n"] == n]
        keys = part["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        times = part[[f"c{i}" for i in range(len(langs))]].to_numpy(np.float64)[order]
        tables.append((keys[order], np.log((times + 0.5) / (times.sum(0) + 0.5 * (len(keys) + 1)))))
    total = sum(priors.values())
    return {"langs": langs, "prior": np.log([priors[x] / total for x in langs]), "tables": tables}


@cache
def _lookup(which: int, n: int, model) -> Lookup:
    return Lookup(model.value["tables"][n][0], 20)


def judged(column: pa.Array, model) -> tuple[list[str], np.ndarray]:
    value = model.value
    s, count = Spelling(column), len(column)
    if not value["langs"]:
        return [UNKNOWN] * count, np.zeros(count)
    sums = np.tile(value["prior"], (count, 1))

    def add(text, values):
        for k in range(len(value["langs"])):
            sums[:, k] += np.bincount(text, values[:, k], count)

    at = _lookup(id(model), 0, model).find(s.words())
    known = at >= 0
    add(s.text[known], value["tables"][0][1][at[known]])
    rest = np.flatnonzero(~known)
    for n in range(MAX_N, 0, -1):
        hashes, word = s.grams(rest, n)
        at = _lookup(id(model), n, model).find(hashes)
        hit = at >= 0
        add(s.text[word[hit]], value["tables"][n][1][at[hit]] / n)
        met = np.zeros(len(s.starts), bool)
        met[word[hit]] = True
        rest = rest[~met[rest]]
    best = sums.argmax(1)
    share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    names = np.where(s.lettered, np.array(value["langs"], object)[best], UNKNOWN)
    return list(names), np.where(s.lettered, share, 0.0)


def predict(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred and score. Only the text takes part in the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches):
        for batch in batches:
            names, scores = [], []
            for low, high in portions(batch.column(0)):
                n, s = judged(batch.column(0)[low:high], shared)
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    rows = docs.select(F.col(text).alias("text"), *[F.col(c).alias(f"kept {i}") for i, c in enumerate(keep)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    found = rows.mapInArrow(named, ", ".join([*fields, "lang_pred string", "score double"]))
    return found.select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
