"""Quality by perplexity: an interpolated modified Kneser-Ney bigram model trained on trusted texts.

Words are runs without white space, case kept. The vocabulary is every word that occurs twice in the trusted texts, however
many there are. Any other word is <unk>, whose probability is shared evenly among the words seen once. Counts and
statistics are of all trusted texts. Bigrams seen fewer than ``least`` times (1: none, 2: those seen once) are pruned, their
mass going to the back-off weight of their context, so each context still sums to one. ``accepted`` and the query prune none.

What depends on single words (back-off weights, lowest-order probabilities) is broadcast for the HOT_WORDS commonest words,
as are the HOT commonest bigrams; so hot words and bigrams never meet in one task. What belongs to the other words and
bigrams is found by a sharded join with one table: each portion of texts sends one packed list to each shard (its remaining
words and bigrams, less the bigrams that a bit map of fixed size shows to be unknown), and each shard returns one packed
list of sums to the portion. A gain is what a seen bigram adds to the backed-off log-probability, so a text's
log-likelihood is a plain sum. The number of shards grows with the texts, so that a shard's lists stay small. The table is
packed by shard once, and the texts take turns in up to SLICES slices, so the disk holds the lists of one slice at a time.

Which words are known is told exactly and without a join: a bit map of fixed size has the words that are not hot, and the
few others that hit a set bit are listed beforehand. Words and bigrams are 63- and 64-bit hashes.

A text's threshold is the ``quantile`` of the perplexities of trusted texts of its language that were held out of the
training; languages with fewer than ``least`` such texts take the quantile over all languages. Texts above it are rejected.

Null and blank texts have no perplexity and are not rejected (there is nothing to judge); a null language is a language;
without trusted texts nothing is rejected. Repeated rows are judged alike, each for itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .frames import bucketed, discard, free_name, numbered, stored, tidied
from .words import BASE, SPACE, Lookup, Words, mix, portions

MAX_WORDS = None  # the vocabulary has no limit
HOT_WORDS = (1 << 16) - 2
UNK, START, FIRST = 0, 1, 2  # word numbers
LOW, BOTH = 1 << 40, (1 << 40) + 1  # in place of a second word: a word's own terms, without and with its back-off weight
SIGN = np.uint64(1 << 63)
HOT = 1 << 16
SHARD_BYTES = 32 << 20  # text for each shard of the count table
SLICE_BYTES, SLICES = 128 << 20, 4  # text for each slice, until there are so many
PACKED_ROWS = 1 << 20  # of the count table, packed at a time
FEW_REJECTED = 1 << 20  # rows whose numbers are broadcast
FEW_LURES = 1 << 22  # keys whose hashes are
BITS = 1 << 27
HELD_OUT = 5  # one trusted text in so many


def bit_map(keys: DataFrame, at: str, size: int = BITS) -> np.ndarray:
    """``size`` bits, set at each value of ``at`` (below it): by default a fixed 16 MB on the driver, whatever the number of keys."""
    at = keys.select((F.col(at) + 1).alias("at"))  # these functions count from 1
    with tidied(keys.sparkSession):
        rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(r["bits"], np.uint8)
        low = (r["bucket"] - 1) * 4096
        out[low : low + len(piece)] = piece[: len(out) - low]
    return out


def shipped(bits: np.ndarray) -> bytes:
    """A bit map to broadcast: every executor keeps a file of it, which grows with the bits that are set."""
    return zstandard.compress(bits.tobytes(), 1)


def received(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload), np.uint8)


def bits_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def trusted_texts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts whose key is in ``trusted``, less the held-out ones. A bit map tells which they are, less the few other keys that
    hit a set bit; no text is shuffled unless these are more than FEW_LURES."""
    ids = trusted.select(F.col(key).alias("key")).where(F.col("key").isNotNull() & ~is_held_out(F.col("key"))).distinct()
    spark, of_key = docs.sparkSession, F.xxhash64("key")
    bits = spark.sparkContext.broadcast(shipped(bit_map(ids.select(F.pmod(of_key, F.lit(BITS)).alias("at")), "at")))

    def likely(lures):
        def passed(batches):
            mine, others = received(bits.value), lures.value
            for batch in batches:
                hashes = batch.column("hash").to_numpy(zero_copy_only=False)
                good = bits_set(mine, hashes & (BITS - 1))
                if len(others):
                    good &= others[np.minimum(np.searchsorted(others, hashes), len(others) - 1)] != hashes
                yield batch.filter(pa.array(good))

        return passed

    none = spark.sparkContext.broadcast(np.zeros(0, np.int64))
    keys = docs.select(F.col(key).alias("key")).where("key IS NOT NULL").withColumn("hash", of_key)
    wrong = keys.mapInArrow(likely(none), keys.schema).join(ids, "key", "left_anti").select("hash").distinct()
    wrong = stored(wrong, "lures", tidy=True)
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", of_key)
    if wrong.count() > FEW_LURES:
        texts = rows.mapInArrow(likely(none), rows.schema).join(ids, "key", "left_semi").select("key", "text")
    else:
        lures = spark.sparkContext.broadcast(np.sort(wrong.toPandas()["hash"].to_numpy(np.int64)))
        texts = rows.mapInArrow(likely(lures), rows.schema).select("key", "text")
        texts.made_of = rows, likely(lures)
    discard(wrong)
    return texts


def is_held_out(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("held out")), F.lit(HELD_OUT)) == 0


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0
    return tuple(min(max(x, 0.0), float(i + 1)) for i, x in enumerate(d))


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.select([counts <= 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2]), 0)


class Vocabulary:
    """Numbers of words: hot ones count from FIRST, other known ones have their hash with the sign set, the rest are UNK."""

    def __init__(self, hot: np.ndarray, bits: np.ndarray, lures: np.ndarray):
        self.hot, self.bits, self.lures = Lookup(hot, 20), bits, Lookup(lures, 20)

    def likely(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are not hot and hit a set bit."""
        rest = np.flatnonzero(self.hot.find(hashes) < 0)
        return rest[bits_set(self.bits, (hashes[rest] & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64))]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = self.hot.find(hashes).astype(np.int64)
        number = np.where(at < 0, UNK, at + FIRST)
        rest = self.likely(hashes)
        rest = rest[self.lures.find(hashes[rest]) < 0]
        number[rest] = (hashes[rest] | SIGN).view(np.int64)
        return number


def before(words: Words, number: np.ndarray) -> np.ndarray:
    """Number of what stands before each word (each text begins after START)."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[words.bounds[:-1][words.counts > 0]] = START
    return out


def pair(u: np.ndarray, v: np.ndarray | int) -> np.ndarray:
    """64-bit keys of bigrams."""
    return mix(u.astype(np.uint64) * BASE + np.asarray(v).astype(np.uint64)).view(np.int64)


def _of(values: np.ndarray, number: np.ndarray, other: float = 0.0) -> np.ndarray:
    """Values of hot words; ``other`` for words that are not."""
    return np.where(number < 0, other, values[np.maximum(number, 0)])


def _rest(table: DataFrame, top, most: int, key: str) -> DataFrame:
    """The rows that come after the ``most`` commonest, ``top``."""
    if len(top) < most:
        return table.where("false")
    times, last = (int(top[c].iloc[-1]) for c in ("times", key))
    return table.where((F.col("times") < times) | ((F.col("times") == times) & (F.col(key) > last)))


def _hashes(rows: DataFrame) -> np.ndarray:
    return np.sort(rows.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))


def fit(texts: DataFrame, hot: int = HOT, hot_words: int = HOT_WORDS, size: int = BITS, least: int = 2) -> dict:
    """The model of (key, text) rows: arrays of hot words and bigrams for the driver to broadcast; ``cold``, the other known
    words; and ``tail``, the table of what belongs to the other words and bigrams, made of the stored ``tables``. ``size`` is
    that of the words' bit map."""
    with tidied(texts.sparkSession):
        return _fit(texts, hot, hot_words, size, least)


def _fit(texts: DataFrame, hot: int, hot_words: int, size: int, least: int) -> dict:
    spark = texts.sparkSession
    # texts are chosen by the Python worker that reads them: with a step each, two workers a task would hold memory
    texts, chosen = getattr(texts, "made_of", (texts, lambda batches: batches))
    texts = texts.select("text", *[c for c in texts.columns if c != "text"])

    def words_of(batches):
        for batch in chosen(batches):
            for low, high in portions(batch.column(0)):
                found, times = np.unique(Words(batch.column(0)[low:high], SPACE).hashes().view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["hash", "times"])

    counts = stored(texts.mapInArrow(words_of, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times")), "words", tidy=True)
    known = counts.where("times > 1")
    n_known = known.count()
    rare = max(1, counts.count() - n_known)
    kept = known.orderBy(F.desc("times"), "hash").limit(hot_words).toPandas()
    cold = stored(_rest(known, kept, hot_words, "hash").select("hash"), "cold")
    keys = np.sort(kept["hash"].to_numpy(np.int64).view(np.uint64))
    bits = bit_map(cold.select(F.col("hash").bitwiseAND(size - 1).alias("at")), "at", size)
    shared = spark.sparkContext.broadcast((keys, shipped(bits)))

    def lured(batches):
        bits = received(shared.value[1])
        for batch in batches:
            yield batch.filter(pa.array(bits_set(bits, batch.column(0).to_numpy() & (size - 1))))

    lures = spark.sparkContext.broadcast(_hashes(counts.where("times = 1").select("hash").mapInArrow(lured, "hash long")))

    discard(counts)

    def bigrams_of(batches):
        keys, bits = shared.value
        vocabulary = Vocabulary(keys, received(bits), lures.value)
        for batch in chosen(batches):
            for low, high in portions(batch.column(0)):
                words = Words(batch.column(0)[low:high], SPACE)
                number = vocabulary.numbers(words.hashes())
                first = before(words, number)
                _, at, times = np.unique(pair(first, number), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first[at], number[at], times.astype(np.int64))], names=["u", "v", "times"])

    bigrams = texts.mapInArrow(bigrams_of, "u long, v long, times long").groupBy("u", "v").agg(F.sum("times").alias("times"))
    bigrams = stored(bigrams.sortWithinPartitions("u", "v"), "bigrams", tidy=True)  # sorted, it is a smaller file
    shared.destroy()
    lures.destroy()

    # by context and by word: rows for every known word; only those of hot ones are collected
    seen = [F.sum(F.when(F.col("times") == i, 1).otherwise(0)) for i in (1, 2)] + [F.sum(F.when(F.col("times") > 2, 1).otherwise(0))]
    context = stored(bigrams.groupBy("u").agg(F.sum("times").alias("total"), *[x.alias(f"n{i}") for i, x in enumerate(seen, 1)]), "contexts", tidy=True)
    endings = stored(bigrams.groupBy("v").agg(F.count("*").alias("n")), "endings", tidy=True)
    d = _discounts(_few(bigrams, "times"))
    e = _discounts(_few(endings, "n"))
    sums = endings.groupBy(F.least("n", F.lit(3)).alias("kind")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    mass = max(1.0, sum(r["n"] for r in sums))
    spread = (mass - sum(r["n"] - e[r["kind"] - 1] * r["words"] for r in sums)) / (n_known + FIRST)

    def weights(n1, n2, n3, total):
        return (n1 * (d[0] if least < 2 else 1.0) + d[1] * n2 + d[2] * n3) / total

    def likelihoods(n):
        return (_discounted(n, e) + spread) / mass

    of, ended = context.where("u >= 0").toPandas(), np.zeros(len(keys) + FIRST)
    backoff, totals = np.ones(len(keys) + FIRST), np.ones(len(keys) + FIRST)
    backoff[of["u"]] = weights(of["n1"], of["n2"], of["n3"], of["total"])
    totals[of["u"]] = of["total"]
    of = endings.where("v >= 0").toPandas()
    ended[of["v"]] = of["n"]
    lowest = likelihoods(ended)
    share = spark.sparkContext.broadcast((backoff, totals, lowest))

    def gains(batches):
        backoff, totals, lowest = share.value
        for batch in batches:
            u, v, times, total, *n, ends = (batch.column(i).to_numpy() for i in range(8))
            with np.errstate(divide="ignore", invalid="ignore"):
                under = np.where(u < 0, weights(*n, total), _of(backoff, u)) * np.where(v < 0, likelihoods(ends), _of(lowest, v))
                gain = np.log1p(_discounted(times.astype(float), d) / np.where(u < 0, total, _of(totals, u)) / under)
            yield pa.RecordBatch.from_arrays([pa.array(pair(u, v)), batch.column(2), pa.array(gain)], names=["key", "times", "gain"])

    def own_terms(batches):
        for batch in batches:
            w, ends, total, *n = (batch.column(i).to_numpy() for i in range(6))
            low = np.log(likelihoods(ends))
            with np.errstate(divide="ignore", invalid="ignore"):
                both = low + np.where(total > 0, np.log(weights(*n, total)), 0.0)
            for key, term in ((pair(w, LOW), low), (pair(w, BOTH), both)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(term)], names=["key", "gain"])

    # only what has a word that is not hot is joined, so no key is common
    none = [F.lit(0).cast("long").alias(c) for c in ("total", "n1", "n2", "n3")]
    rows = bigrams.where(F.col("times") >= least)
    rows = rows.where("u >= 0").select("u", "v", "times", *none).unionByName(rows.where("u < 0").join(context.where("u < 0"), "u"))
    rows = rows.where("v >= 0").withColumn("n", none[0]).unionByName(rows.where("v < 0").join(endings.where("v < 0"), "v"))
    rows = rows.select("u", "v", "times", "total", "n1", "n2", "n3", F.col("n").alias("ends"))
    table = stored(rows.mapInArrow(gains, "key long, times long, gain double"), "gains", tidy=True)
    ends = endings.where("v < 0").join(context.where("u < 0"), F.col("u") == F.col("v"), "left")
    ends = ends.select("v", "n", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "n1", "n2", "n3")])
    ends = stored(ends.mapInArrow(own_terms, "key long, gain double"), "terms", tidy=True)
    share.destroy()
    top = table.orderBy(F.desc("times"), "key").limit(hot).toPandas()
    tail = _rest(table, top, hot, "key").select("key", "gain").unionByName(ends)
    discard(bigrams, context, endings)
    order = np.argsort(top["key"].to_numpy(np.int64).view(np.uint64))
    with np.errstate(divide="ignore"):
        words = {"keys": keys, "bits": bits, "backoff": np.log(backoff), "lowest": np.log(lowest) - np.where(np.arange(len(lowest)) == UNK, np.log(rare), 0.0)}
    cold = cold if n_known > len(keys) else None
    return {**words, "hot": top["key"].to_numpy(np.int64)[order], "gain": top["gain"].to_numpy(float)[order], "tail": tail, "cold": cold, "tables": (table, ends)}


def _few(table: DataFrame, column: str) -> list[int]:
    """How many rows have one to four of ``column``."""
    found = {r[column]: r["count"] for r in table.where(F.col(column) < 5).groupBy(column).count().collect()}
    return [found.get(i, 0) for i in (1, 2, 3, 4)]


def _lures(docs: DataFrame, text: str, model: dict) -> np.ndarray:
    """Words of the texts that hit a set bit of the vocabulary's map and are not known."""
    if model["cold"] is None:
        return np.zeros(0, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((model["keys"], shipped(model["bits"])))

    def likely(batches):
        keys, bits = shared.value
        vocabulary = Vocabulary(keys, received(bits), np.zeros(0, np.uint64))
        for batch in batches:
            for low, high in portions(batch.column(0)):
                hashes = np.unique(Words(batch.column(0)[low:high], SPACE).hashes())
                yield pa.RecordBatch.from_arrays([pa.array(hashes[vocabulary.likely(hashes)].view(np.int64))], names=["hash"])

    found = stored(docs.select(text).mapInArrow(likely, "hash long").distinct().join(model["cold"], "hash", "left_anti"), "lures", tidy=True)
    shared.destroy()
    hashes = _hashes(found)
    discard(found)
    return hashes


def places(key: np.ndarray) -> np.ndarray:
    """Lower bits of keys: their place in the bit map, and by the remainder their shard."""
    return key & (BITS - 1)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, since most planes are nearly constant."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.compress(planes, 1)


def _unpacked(payload: bytes, *kinds) -> list[np.ndarray]:
    n, planes, at, out = int.from_bytes(payload[:8], "little"), zstandard.decompress(payload[8:]), 0, []
    for kind in map(np.dtype, kinds):
        piece = np.frombuffer(planes, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(piece.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _sharded(tail: DataFrame, shards: int) -> DataFrame:
    """The count table as packed lists of keys and gains, one for each shard and PACKED_ROWS rows."""

    def packed(key: np.ndarray, gain: np.ndarray) -> pa.RecordBatch:
        shard = places(key) % shards
        order = np.lexsort((key.view(np.uint64), shard))
        key, gain, shard = key[order], gain[order], shard[order]
        edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(key))
        lists = [_packed(np.diff(key[a:b].view(np.uint64), prepend=np.uint64(0)), gain[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int32)), pa.array(lists, pa.binary())], names=["shard", "payload"])

    def split(batches):
        keys, gains, n = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            gains.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield packed(np.concatenate(keys), np.concatenate(gains))
                keys, gains, n = [], [], 0
        if n:
            yield packed(np.concatenate(keys), np.concatenate(gains))

    return tail.select("key", "gain").mapInArrow(split, "shard int, payload binary")


def perplexities(docs: DataFrame, model: dict, keep: list[str], text: str = "text", shard_bytes: int = SHARD_BYTES, slice_bytes: int = SLICE_BYTES, spend: bool = False) -> DataFrame:
    """The columns ``keep`` of each text, n_words and perplexity, stored. With ``spend`` the model's tables are deleted as soon
    as they are packed, so the model serves no second time."""
    import pandas as pd

    spark = docs.sparkSession
    size = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    shards, slices = max(16, -(-size // shard_bytes)), min(SLICES, max(1, -(-size // slice_bytes)))
    lures, bits = _lures(docs, text, model), bit_map(model["tail"].select(F.col("key").bitwiseAND(BITS - 1).alias("at")), "at")
    in_turn = F.pmod(F.pmod(F.col("key").bitwiseAND(BITS - 1), F.lit(shards)), F.lit(slices))
    parts = [_sharded(model["tail"].where(in_turn == i), shards) for i in range(slices)]
    known = bucketed(parts, "tail", "shard", shards)  # each slice of texts asks it where it is
    if spend:
        discard(*model["tables"])
    sent_along = {k: model[k] for k in ("keys", "backoff", "lowest", "hot", "gain")}
    shared = spark.sparkContext.broadcast((sent_along, shipped(model["bits"]), lures, shipped(bits)))
    kept = [F.col(c).alias(f"kept {i}") for i, c in enumerate(keep)]

    def sent(batches):
        """For each portion its own columns, base sums included, as one row; and one row for each shard."""
        model, words_bits, lures, bits = shared.value
        bits = received(bits)
        vocabulary = Vocabulary(model["keys"], received(words_bits), lures)
        hot, gain = Lookup(model["hot"].view(np.uint64), 20), np.append(model["gain"], 0.0)
        for batch in batches:
            for low, high in portions(batch.column(0)):
                words = Words(batch.column(0)[low:high], SPACE)
                number = vocabulary.numbers(words.hashes())
                first = before(words, number)
                key = pair(first, number)
                at, texts = hot.find(key.view(np.uint64)), words.texts()
                log = _of(model["backoff"], first) + _of(model["lowest"], number) + gain[at]  # the last gain is that of no hit
                base = np.bincount(texts, log, len(words.counts))
                own = pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[low:high] for i in range(2, batch.num_columns)), pa.array(words.counts.astype(np.int64)), pa.array(base)],
                    names=[*batch.schema.names[2:], "n_words", "base"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                block = batch.column(1)[low].as_py()
                out = [(block % shards, block, sink.getvalue().to_pybytes(), True)]
                rest = np.flatnonzero(at < 0)
                rest = rest[bits_set(bits, places(key[rest]))]
                cold, final = np.flatnonzero(number < 0), np.zeros(len(number), bool)
                final[words.bounds[1:][words.counts > 0] - 1] = True
                key = np.concatenate([key[rest], pair(number[cold], np.where(final[cold], LOW, BOTH))])
                texts = np.concatenate([texts[rest], texts[cold]])
                order = np.lexsort((texts, key))
                key, texts = key[order], texts[order]
                once = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (texts[1:] != texts[:-1]))[: len(key)])
                key, texts, times = key[once], texts[once], np.diff(np.append(once, len(key)))
                shard = places(key) % shards
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                for i in np.flatnonzero(np.diff(edges)):
                    those = order[edges[i] : edges[i + 1]]
                    steps = np.diff(key[those].view(np.uint64), prepend=np.uint64(0))
                    out.append((int(i), block, _packed(steps, texts[those].astype(np.uint32), times[those].astype(np.uint32)), False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.bool_()))], names=["shard", "block", "payload", "own"]
                )

    def answered(key, asked, known):
        keys, gain, out = np.zeros(0, np.uint64), np.zeros(0), []
        if len(asked) and len(known):
            lists = [_unpacked(x, np.uint64, float) for x in known["payload"]]
            keys, gain = np.concatenate([np.cumsum(steps) for steps, _ in lists]), np.concatenate([x for _, x in lists])
            order = np.argsort(keys)
            keys, gain = keys[order], gain[order]
        for block, payload, own in zip(asked["block"], asked["payload"], asked["own"]):
            if own:
                out.append((block, payload, True))
                continue
            steps, texts, times = _unpacked(payload, np.uint64, np.uint32, np.uint32)
            wanted = np.cumsum(steps)
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            sums = np.bincount(texts[hit], gain[at[hit]] * times[hit])
            some = np.flatnonzero(sums)
            if len(some):
                out.append((block, _packed(np.diff(some, prepend=0).astype(np.uint32), sums[some].astype(np.float32)), False))
        return pd.DataFrame(out, columns=["block", "payload", "own"])

    def summed(tables):
        """All rows of one portion, its own and the shards' answers."""
        own, gains = None, []
        for payload, mine in zip(tables.column("payload").to_pylist(), tables.column("own").to_pylist()):
            if mine:
                own = pa.ipc.open_stream(payload).read_all()
            else:
                gains.append(_unpacked(payload, np.uint32, np.float32))
        log = own.column("base").to_numpy().copy()
        for steps, sums in sorted(gains, key=lambda g: (len(g[0]), g[0].tobytes())):  # an order of its own: sums repeat
            log[np.cumsum(steps.astype(np.int64))] += sums
        n = own.column("n_words").to_numpy()
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            values = np.exp(-log / n)
        values = pa.array(values, mask=n == 0)
        return pa.table([*own.columns[:-1], values], names=[*own.schema.names[:-1], "perplexity"])

    found = []
    for i in range(slices):
        part = docs.where(F.pmod(F.xxhash64(text), F.lit(slices)) == i) if slices > 1 else docs
        rows = part.select(F.col(text).alias("text"), F.monotonically_increasing_id().alias("block"), *kept)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]
        asked = rows.mapInArrow(sent, "shard int, block long, payload binary, own boolean")
        answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(answered, "block long, payload binary, own boolean")
        sums = answers.groupBy("block").applyInArrow(summed, ", ".join([*fields, "n_words long", "perplexity double"]))
        found.append(stored(sums.select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(keep)], "n_words", "perplexity"), "perplexities", tidy=True))
    shared.destroy()
    discard(known)
    return reduce(DataFrame.unionByName, found)


def judge(scores: DataFrame, trusted: DataFrame, key: str = "doc_id", lang: str = "lang", quantile: float = 0.995, least: int = 30) -> DataFrame:
    """``scores`` (which has key, lang, perplexity) with the threshold of each row's language and whether it is rejected.

    Only keys, languages and perplexities are joined.
    """
    ids = trusted.select(F.col(key).alias("trusted key")).where(F.col("trusted key").isNotNull() & is_held_out(F.col("trusted key"))).distinct()
    spoken = F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))
    measured = scores.where("perplexity IS NOT NULL").join(ids, F.col(key) == F.col("trusted key"), "left_semi").select(spoken.alias("spoken"), "perplexity")
    limits = measured.groupBy("spoken").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("own"), F.count("*").alias("n"))
    every = measured.agg(F.percentile_approx("perplexity", quantile, 100_000)).first()[0]
    limits = limits.select("spoken", F.when(F.col("n") >= least, F.col("own")).alias("own"))
    threshold = F.coalesce(F.col("own"), F.lit(every).cast("double"))
    rejected = F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))
    return scores.withColumn("spoken", spoken).join(limits, "spoken", "left").withColumn("threshold", threshold).drop("spoken", "own").withColumn("rejected", rejected)


def accepted(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the model of the ``trusted`` keys' texts does not reject."""
    row = free_name(docs.columns, "row")
    counted = numbered(docs, row)
    model = fit(trusted_texts(docs, trusted.select(trusted.columns[0]).toDF(key), key, text), least=1)
    scores = perplexities(counted, model, [row, key, lang], text, spend=True)
    rejected = stored(judge(scores, trusted.toDF(key), key, lang, **options).where("rejected").select(row), "rejected", tidy=True)
    if rejected.count() <= FEW_REJECTED:
        rejected = F.broadcast(rejected)  # else the texts are shuffled
    return counted.join(rejected, row, "left_anti").select(*docs.columns)
