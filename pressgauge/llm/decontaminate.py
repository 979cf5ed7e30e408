"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every window of the texts.

Words are lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters. A benchmark item gives all its windows
of ``width`` words, or itself when it is shorter. A hash hit is verified word by word before it counts.

The set is broadcast in blocks of at most MAX_WINDOWS windows, each a further pass within the same scan, so what is
broadcast is bounded whatever the benchmark's size. Nothing is shuffled: a text's verdict rests on itself and the set.

Null or empty texts have no words and no hits; null items give no windows; an item without id makes hits but is not
listed; repeated items and rows change nothing but are all reported; ``scan`` keeps all columns of the texts and names
its own column so that it clashes with none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .frames import free_name
from .words import PUNCT, Words, grams, portions, within

MAX_WINDOWS = 200_000
FINDING = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    # words and code points, both with exclusive ends; sorted and merged
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField(x, T.LongType()) for x in ("first_word", "last_word", "start", "end")
    ]))),
])
ARROW_FINDING = pa.struct([
    ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "last_word", "start", "end")]))),
])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = 13) -> DataFrame:
    """One row for each distinct window: its hash, number of words, words, and the items that have it."""

    def windows(batches):
        for batch in batches:
            words = Words(batch.column(1), PUNCT, lower=True)
            hashes, rows = words.hashes(), []
            for i, n in enumerate(words.counts):
                size, low = min(int(n), width), int(words.bounds[i])
                for a in range(low, low + int(n) - size + 1) if size else ():
                    rows.append((int(grams(hashes[a : a + size], size)[0].view(np.int64)), size, words.joined(a, a + size), batch.column(0)[i].as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.string()))],
                names=["hash", "n", "words", "item"],
            )

    found = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).mapInArrow(
        windows, "hash long, n int, words binary, item string"
    )
    return found.groupBy("hash", "n", "words").agg(F.collect_set("item").alias("items"))


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for a, b, start, end in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2], end)
        else:
            out.append((a, b, start, end))
    return out


def _pass(known, text_at: int, finding_at: int | None):
    """Batches with the findings of one block of windows, added to what earlier blocks found."""

    def found(column: pa.Array, before: list) -> list[dict]:
        words = Words(column, PUNCT, lower=True)
        hashes, hits = words.hashes(), {}
        for size, (small, windows) in known.value.items():
            codes = grams(hashes, size)
            likely = np.flatnonzero(small[codes >> np.uint64(40)] & within(words, size)) if len(codes) else ()
            for a in likely:
                if (have := windows.get(int(codes[a]))) is not None and (items := have.get(words.joined(a, a + size))) is not None:
                    hits.setdefault(int(np.searchsorted(words.bounds, a, "right")) - 1, []).append((int(a), size, items))
        out = []
        for i, n in enumerate(words.counts):
            spans = [tuple(s.values()) for s in before[i]["spans"]] if before else []
            items = set(before[i]["items"]) if before else set()
            if i in hits:
                at, low = words.points(i), int(words.bounds[i])
                for a, size, ids in hits[i]:
                    items |= ids
                    spans.append((a - low, a - low + size, int(at[words.starts[a] - words.offsets[i]]), int(at[words.ends[a + size - 1] - words.offsets[i]])))
            out.append({"n_words": int(n), "items": sorted(items), "spans": [dict(zip(("first_word", "last_word", "start", "end"), s)) for s in _merged(spans)]})
        return out

    def passed(batches):
        for batch in batches:
            rows = []
            for low, high in portions(batch.column(text_at)):
                before = batch.column(finding_at)[low:high].to_pylist() if finding_at is not None else []
                rows += found(batch.column(text_at)[low:high], before)
            column = pa.array(rows, ARROW_FINDING)
            kept = [c for k, c in enumerate(batch.columns) if k != finding_at]
            names = [n for k, n in enumerate(batch.schema.names) if k != finding_at]
            yield pa.RecordBatch.from_arrays([*kept, column], names=[*names, "finding"])

    return passed


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one more, whose name is returned too: n_words, items and merged spans of hit words."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item, item_text, width).withColumn("block", F.lit(0))
    total = windows.count()
    blocks = max(1, -(-total // max_windows))
    name = free_name(docs.columns, "contamination")
    out, where = docs, docs.columns.index(text)
    for block in range(blocks):
        rows = windows.where(F.pmod("hash", F.lit(blocks)) == block).collect()  # about max_windows rows
        by_size: dict[int, dict] = {}
        for r in rows:
            by_size.setdefault(r["n"], {}).setdefault(r["hash"] % 2**64, {})[bytes(r["words"])] = frozenset(r["items"])
        known = {}
        for size, have in by_size.items():
            small = np.zeros(1 << 24, bool)
            small[np.fromiter(have, np.uint64, len(have)) >> np.uint64(40)] = True
            known[size] = small, have
        schema = T.StructType([*docs.schema.fields, T.StructField(name, FINDING)])
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(known), where, len(docs.columns) if block else None), schema)
    return out, name


def hit_words(finding: Column) -> Column:
    return F.aggregate(finding["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"])


def is_contaminated(finding: Column, one_in: int = 20) -> Column:
    """At least one word in ``one_in`` is hit."""
    return (hit_words(finding) > 0) & (one_in * hit_words(finding) >= finding["n_words"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    found, name = scan(docs, benchmark, **options)
    return found.where(~is_contaminated(F.col(name))).select(*docs.columns)


def clean_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows of ``docs``, the hit passages cut out of their texts."""
    found, name = scan(docs, benchmark, text=text, **options)
    spans = F.col(name)["spans"]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(F.col(text), x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int")))
    kept = F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return found.select(*[kept.alias(c) if c == text else F.col(c) for c in docs.columns])
