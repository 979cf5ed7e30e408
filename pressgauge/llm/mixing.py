"""Mixing sources to target weights: packed blocks, multinomial counts per output shard, permuted block indexes.

The words of a source, its texts laid end to end in a pseudorandom order, are packed into blocks of ``block`` words (the
last may be shorter). Each output shard has about ``shard`` slots. A shard gives a source the whole part of its expected
number of slots, and the slots left over are drawn from the multinomial distribution of the fractions, which keeps every
expectation and little variance. The j-th slot of a source takes block ``permuted(j mod blocks)`` of pass ``j div blocks``;
each pass has its own permutation (a swap-or-not network, a bijection on any number of blocks). Slots beyond MOST passes
are left empty, so no word is taken more than MOST times.

Targets share all words by weight; a target stops at MOST times its source's words and the excess goes to the others by
weight until none is above.

Running sums go over about sqrt(n) buckets of about sqrt(n) rows, so a source with a third of all rows is spread like any
other. Only the table of sources (at most MAX_SOURCES rows, else an error) is brought to the driver.

Null texts have no words and null sources are one source, the last. Empty texts are never taken. Repeated rows are texts
of their own. An empty table gives no rows. Everything is drawn from hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import free_name
from .winnow import let

MOST = 3
MAX_SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def source_key(source: Column) -> Column:
    """Never null: the null source is the empty string, others begin with a sign."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the summed sizes by weight, each at most MOST times its size."""
    out = [0.0] * len(sizes)
    rest, weight = float(sum(sizes)), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: MOST * sizes[i] / weights[i]):
        out[i] = min(float(MOST * sizes[i]), rest * weights[i] / weight)
        if out[i] == MOST * sizes[i]:  # the others share what is left
            rest -= out[i]
            weight -= weights[i]
    return out


def before(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the same keys: within buckets, then over whole buckets."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(*keys, bucket).agg(F.sum(value).alias("bucket sum")).withColumn("earlier buckets", F.coalesce(F.sum("bucket sum").over(across), F.lit(0))).drop("bucket sum")
    return (
        df.withColumn(out, F.sum(value).over(inside) - F.col(value)).join(whole, [*keys, bucket])
        .withColumn(out, F.col(out) + F.col("earlier buckets")).drop("earlier buckets", bucket)
    )


def permuted(x: Column, n: Column, *salt: Column, rounds: int = 12) -> Column:
    """A bijection on 0 .. n-1, chosen by the salt."""

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*salt, r), n) - x, n)
        return F.when(F.xxhash64(*salt, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x, swapped)


class Mix:
    """The mix of ``docs``: ``sources`` on the driver, ``rows`` (texts and their place), ``slots`` (the blocks taken).

    ``keep`` columns of the texts appear in ``rows`` beside src, size, place. The order of a source's texts is drawn from
    the ``order`` columns (those kept, unless given) and the text.
    """

    def __init__(self, docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", weights=lambda i: i % 3 + 1, block: int = 128, shard: int = 1024, seed: int = 7, order: list[str] | None = None):
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        words = F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
        kept = [F.col(c).alias(f"kept {i}") for i, c in enumerate(keep)]
        self.narrow = docs.select(*kept, source_key(F.col(source)).alias("src"), F.when(F.col(text).isNull(), F.lit(0)).otherwise(words).alias("size"), F.xxhash64(*(order or keep), text).alias("draw"))
        summed = self.narrow.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(summed) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        # code point order is the order of the UTF-8 bytes; the null source comes last
        summed.sort(key=lambda r: (r["src"] == "", r["src"].encode()))
        self.texts = sum(r["n"] for r in summed)
        sizes = [r["size"] for r in summed]
        goals = targets(sizes, [weights(i) for i in range(len(sizes))])
        blocks = [-(-n // block) for n in sizes]
        wanted = [g * b / n if n else 0.0 for g, b, n in zip(goals, blocks, sizes)]
        self.shards = max(1, round(sum(wanted) / shard))
        each = math.ceil(sum(wanted) / self.shards)
        expected = [each * w / sum(wanted) if w else 0.0 for w in wanted]
        whole = [math.floor(x) for x in expected]
        self.drawn = each - sum(whole)
        parts = [x - f for x, f in zip(expected, whole)]
        scale = self.drawn / sum(parts) if sum(parts) else 0.0
        self.sources, low = [], 0.0
        for r, goal, n, f, p in zip(summed, goals, blocks, whole, parts):
            high = low + p * scale
            self.sources.append((r["src"], r["size"], goal, n, f, low, high))
            low = high
        self.table = self.spark.createDataFrame(self.sources, "src string, source_size long, target double, blocks long, each_shard long, low double, high double")
        self.keep = keep

    def rows(self) -> DataFrame:
        """Texts with the place of their first word in the source's stream."""
        buckets = math.isqrt(self.texts) + 1
        placed = self.narrow.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
        return before(placed, ["src"], "bucket", ["draw", "size"], "size", "place").drop("draw")

    def slots(self) -> DataFrame:
        """One row for each slot filled: shard, src, pass, index of the block."""
        shards, fixed = F.lit(self.shards).cast("long"), self.table.where("each_shard > 0 AND blocks > 0")
        steady = (
            fixed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
            .select("src", "blocks", "shard", (F.col("shard") * F.col("each_shard")).alias("first"), F.col("each_shard").alias("count"))
        )
        parts = steady
        if self.drawn:
            draws = (
                self.spark.range(self.shards).withColumnRenamed("id", "shard")
                .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(self.drawn - 1))))
                .withColumn("u", F.pmod(F.xxhash64(F.lit(self.seed), "shard", "draw"), F.lit(1 << 53)) / float(1 << 53) * self.drawn)
                .withColumn("unit", F.floor("u"))
            )
            spans = self.table.where("high > low").withColumn("unit", F.explode(F.sequence(F.floor("low"), F.floor("high"))))
            drawn = draws.join(spans, "unit").where("low <= u AND u < high").groupBy("src", "blocks", "each_shard", "shard").agg(F.count("*").alias("count"))
            drawn = drawn.withColumn("bucket", F.floor(F.col("shard") / (math.isqrt(self.shards) + 1)))
            drawn = before(drawn, ["src"], "bucket", ["shard"], "count", "rank")
            parts = steady.unionByName(drawn.select("src", "blocks", "shard", (F.col("each_shard") * shards + F.col("rank")).alias("first"), "count"))
        return (
            parts.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
            .where(F.col("slot") < MOST * F.col("blocks"))
            .withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
            .withColumn("index", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.lit(self.seed + 1), F.col("src"), F.col("pass")))
            .select("shard", "src", "pass", "index")
        )

    def pieces(self) -> DataFrame:
        """One row for each text and block that share words: index, ``begin`` and ``words`` of the text in that block."""
        size = F.lit(self.block).cast("long")
        return (
            self.rows().where("size > 0")
            .withColumn("index", F.explode(F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("size") - 1) / size))))
            .withColumn("begin", F.greatest(F.col("index") * size - F.col("place"), F.lit(0)))
            .withColumn("words", F.least((F.col("index") + 1) * size - F.col("place"), F.col("size")) - F.col("begin"))
        )

    def taken(self) -> DataFrame:
        """The ``keep`` columns of each text, size, source_size, target of its source, and the words taken of it."""
        used = self.slots().groupBy("src", "index").agg(F.count("*").alias("uses"))
        counted = (
            self.pieces().join(used, ["src", "index"], "left")
            .groupBy("src", "place").agg(
                *[F.first(f"kept {i}").alias(f"kept {i}") for i in range(len(self.keep))], F.first("size").alias("size"),
                F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0))).alias("taken"),
            )
        ).drop("place")
        empty = self.narrow.where("size = 0").drop("draw").withColumn("taken", F.lit(0).cast("long"))
        return (
            counted.unionByName(empty).join(self.table.select("src", "source_size", "target"), "src")
            .select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(self.keep)], "size", "source_size", "target", "taken")
        )


def mixed_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: shard, slot, source, pass, index, the keys of the texts in each block, and its words.

    Texts move once to their places and their pieces once to their blocks. ``docs`` must give its rows in the same order
    whenever it is read (a table does).
    """
    row = free_name(docs.columns, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    mix = Mix(numbered, [row], text, source, order=[key], **options)
    size = F.lit(mix.block).cast("long")
    places = mix.rows().where("size > 0").select("src", "size", "place", F.col("kept 0").alias("row"))
    texts = numbered.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("size") - 1) / size))

    def pieces(words: Column) -> Column:
        def piece(i: Column) -> Column:
            begin = F.greatest(i * size - F.col("place"), F.lit(0))
            end = F.least((i + 1) * size - F.col("place"), F.col("size"))
            part = F.array_join(F.slice(words, begin.cast("int") + 1, (end - begin).cast("int")), " ")
            return F.struct(i.alias("index"), F.struct(F.col("place"), F.col("key"), part.alias("part")).alias("part"))

        return F.transform(blocks, piece)

    cut = texts.join(places, "row").select("src", F.explode(let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), pieces)).alias("piece"))
    packed = cut.groupBy("src", "piece.index").agg(F.sort_array(F.collect_list("piece.part")).alias("parts"))  # a block's words at most
    order = Window.partitionBy("shard").orderBy(F.xxhash64("src", "pass", "index"), "src", "pass", "index")
    slots = mix.slots().withColumn("slot", F.row_number().over(order) - 1)
    return slots.join(packed, ["src", "index"]).select(
        "shard", "slot", F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"), "pass", "index",
        F.transform("parts", lambda p: p["key"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"),
    )
