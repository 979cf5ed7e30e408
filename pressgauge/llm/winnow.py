"""Document fingerprints by winnowing, as column expressions.

A text's words (runs without white space, in lower case) give one hash for each run of K words. What has no spaces between
words counts by its characters: each character of UNSPACED scripts, and of words of more than LONG characters, is a word of
its own. Of every W consecutive
hashes the smallest is kept, the rightmost of equal ones, with its position in words. So texts that share a run of
K + W - 1 words share a fingerprint. A text of fewer than K words has its whole sequence as its only run; with fewer than
W runs, the smallest of them is kept. Hashes are compared by their upper 31 bits and kept in full.

Null and empty texts, and those of white space only, have no fingerprints; two such texts are alike (1), one such text
is like no other (0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import stored

K, W = 5, 12
LONG = 32
# Thai to Myanmar, Khmer, Japanese kana, Chinese characters (also the later planes)
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
FAR = r"[^\x{0000}-\x{0DFF}]"  # all of UNSPACED and more, in one range
OVERLONG = rf"[\x20\x09-\x0D][^\x20\x09-\x0D]{{{LONG + 1}}}"
GAP = r"[\x20\x09-\x0D]+"
HALF = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    def split(t: Column) -> Column:
        return F.array_remove(F.split(t, GAP), "")

    low = F.lower(text)
    parts = split(F.regexp_replace(low, f"({UNSPACED})", " $1 "))
    parts = F.flatten(F.transform(parts, lambda w: F.when(F.char_length(w) > LONG, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))))
    # one look at each character: long words are tried where a word begins, and most texts end at the single range
    unspaced = F.rlike(low, F.lit(FAR)) & F.rlike(low, F.lit(UNSPACED))
    unusual = unspaced | F.rlike(F.concat(F.lit(" "), low), F.lit(OVERLONG))
    return F.transform(F.when(unusual, parts).otherwise(split(low)), lambda w: F.xxhash64(w))


def _runs(h: Column, k: int) -> Column:
    def runs(h: Column) -> Column:
        # what lies beyond the end is null and adds nothing to a hash, so a short sequence is its only run
        starts = F.transform(h, lambda v, i: F.xxhash64(v, *[F.get(h, i + j) for j in range(1, k)]))
        return F.slice(starts, F.lit(1), F.greatest(F.size(h) - k + 1, F.lit(1)))

    return let(h, runs)


def _kept(g: Column, w: int) -> Column:
    # order first, then the reversed position, in one number: the minimum is the rightmost of the smallest
    ranked = F.transform(g, lambda v, i: F.shiftrightunsigned(v, 2).bitwiseOR(HALF) - i)

    def minima(o: Column, have: int) -> Column:
        """From minima of ``have`` consecutive numbers to those of ``w``; near the end, of what is left (null is no least)."""
        if have == w:
            return F.slice(o, F.lit(1), F.greatest(F.size(o) - w + 1, F.lit(1)))
        step = min(have, w - have)
        return let(F.zip_with(o, F.slice(o, F.lit(step + 1), F.size(o)), lambda a, b: F.least(a, b)), lambda m: minima(m, have + step))

    def place(m: Column) -> Column:
        return (HALF - m.bitwiseAND(HALF)).cast("int")

    return F.transform(F.array_distinct(let(ranked, lambda o: minima(o, 1))), lambda m: F.struct(F.get(g, place(m)).alias("hash"), place(m).alias("position")))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash, position>>, by position; positions count words from 0."""
    text = F.coalesce(text, F.lit(""))
    return let(_runs(word_hashes(text), k), lambda g: _kept(g, w))


def written(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda p: F.concat_ws(":", F.hex(p["hash"]), p["position"])), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""

    def ratio(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        either = F.size(F.array_union(pair["a"], pair["b"]))
        return F.when(either > 0, both / either).otherwise(F.lit(1.0))

    return let(F.struct(F.transform(a, lambda p: p["hash"]).alias("a"), F.transform(b, lambda p: p["hash"]).alias("b")), ratio)


def successors(narrow: DataFrame, name: str) -> DataFrame:
    """(id, digest, n) rows with next_id and next_digest, in descending order of id, then digest; the first follows the last.

    Null ids come last. Only narrow rows are sorted: by range, then within each range; one row of each range is compared
    across ranges.
    """
    spark = narrow.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.col("digest")]
    ranged = stored(narrow.distinct().repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)
    by_part = Window.partitionBy("part").orderBy(*order)
    rows = ranged.withColumn("row", F.row_number().over(by_part)).withColumn("next", F.lead(F.struct("id", "digest")).over(by_part))
    heads = ranged.groupBy("part").agg(F.min_by(F.struct("id", "digest"), F.struct(F.col("id").isNull(), -F.col("id"), "digest")).alias("head"))
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(whole)).alias("head"))  # one row a part
    return (
        rows.join(heads, "part").withColumn("next", F.coalesce("next", "head"))
        .select("id", "digest", "n", F.col("next")["id"].alias("next_id"), F.col("next")["digest"].alias("next_digest"))
    )


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and the likeness to it and to the next text's.

    The edited text has the last half of its code points replaced by the first as many of the next text, by descending
    integer ``key``. Rows of equal key and text are one document, and each of them is returned. Texts move once, the
    halves once more.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("id"), body.alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.md5(F.concat_ws("|", F.lit("text"), "id", "text"))))
    links = stored(successors(texts.select("id", "digest", F.char_length("text").alias("n")), "winnow-order"), "winnow-next")
    own = texts.select("digest", "text")
    # both sides read the same exchange of texts; the window lets one of each group of repeated rows give its half
    copy = F.count("*").over(Window.partitionBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    given = (
        own.withColumn("copy", copy).where("copy = 1")
        .join(links.withColumnRenamed("digest", "digest before"), F.col("digest") == F.col("next_digest"))
        .select(F.col("digest before").alias("digest"), "id", "n",
                F.substring("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("given"),
                F.transform(fingerprint(F.col("text")), lambda p: p["hash"]).alias("next_hashes"))
    )
    pairs = own.join(given, "digest")
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    result = F.struct(
        F.col("id"), F.col("n").cast("long").alias("n_chars"), F.concat(kept, "given").alias("edited"),
        fingerprint(F.col("text")).alias("prints"), "next_hashes",
    )
    both = let(result, lambda r: F.struct(r.alias("r"), fingerprint(r["edited"]).alias("edited_prints")))

    def row(x):
        r = x["r"]
        following = F.transform(r["next_hashes"], lambda h: F.struct(h.alias("hash")))
        return F.struct(
            r["id"].alias(key), r["n_chars"].alias("n_chars"), F.sha2(r["edited"], 256).alias("edited_sha256"),
            written(r["prints"]).alias("fingerprint"), written(x["edited_prints"]).alias("edited_fingerprint"),
            likeness(r["prints"], x["edited_prints"]).alias("near_edited"), likeness(r["prints"], following).alias("near_next"),
        )

    return pairs.select(let(both, row).alias("row")).select("row.*")
