"""Best-fit decreasing packing of tokenized documents into sequences of at most ``size`` tokens.

A document's tokens are the tokenizer's ids and an end id. Longer documents than a sequence are cut into pieces of ``size``,
the last piece may be shorter; no other document is cut. Pieces are packed by best-fit decreasing: longest first, each into
the open sequence with the least room that still holds it, which a segment tree over room finds in logarithmic time.

Pieces of one length are interchangeable, and so are sequences of one room. So the packing is decided exactly on the counts
of pieces by length, at most ``size`` numbers: a step of the plan says that the next pieces of a length go into a range of
sequences, so many into each (after a best fit that leaves room for another of the same length, that sequence is the best
fit again). There are at most three ranges a length, so the driver's work and the plan have a bound that does not depend on
the data. On Spark each piece then gets its rank among those of its length, from counts of slices of about SLICE pieces and
its rank in its slice, and looks its step up. A length that a third of all pieces have is many slices.

A tokenizer that normalises and splits its text within words only is asked once for each word that a worker meets (tests
compare with whole texts); texts with special tokens' strings, and those of other tokenizers, are tokenized whole. WORDS
bounds what a worker remembers, not what is tokenized.

Null and empty texts have the end id only. Texts may be of any length; pieces of one are not kept together. Repeated rows
are documents of their own. An empty table gives no rows. Of other columns only those of ``keep`` are read; they may have
any name, also names of results, which follow them.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .frames import stored
from .words import portions

SIZE, END = 4096, 1
SLICE = 4096
PORTION = 4 << 20
WORDS, LONG = 400_000, 64
SIGNS = r"!-&(-/:-@\[-`{-~"

# Fixed value: how a tokenizer with word ends splits its text. Words never reach over white space, and a run of letters ends
# where a run of signs begins; only the apostrophe joins them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Tokens:
    """Token ids of texts; from ids of their words where the tokenizer takes words one by one."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as source:
            form = json.load(source)
        self.tokenizer = Tokenizer.from_file(file)
        self.known: dict[str, list[int]] = {}
        self.special = {t["content"]: t["id"] for t in form["added_tokens"]}
        kinds = [[x["type"] for x in (form.get(part) or {}).get(group, [])] for part, group in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        split = form["pre_tokenizer"]["pretokenizers"][0] if kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] else {}
        self.by_word = bool(self.special) and split.get("pattern") == {"Regex": WORD_PATTERN} and split["invert"] and split["behavior"] == "Removed"

    def of(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, end to end, and the offsets of the texts."""
        texts = pc.fill_null(texts, "")
        words = _words(texts)
        coded = words.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist()) if self.by_word else []
        indices = coded.indices.to_numpy()
        count = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        # texts with a special token's string, and all texts of other tokenizers, are taken whole: one word each
        whole = np.full(len(texts), not self.by_word)
        for content in self.special:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if whole.any():
            indices = indices[np.repeat(~whole, count)]
            count = np.where(whole, 1, count)
            at = np.flatnonzero(whole)
            indices = np.insert(indices, (np.cumsum(count) - count)[at] - np.arange(len(at)), len(ids) + np.arange(len(at)))
            ids = ids + [self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in at]
        ids.append([end])
        lengths = np.array([len(x) for x in ids], np.int64)
        pool = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        # after the words of each text comes the end, as one more word
        edges = np.cumsum(count)
        used = np.insert(indices, edges, len(ids) - 1)
        size = lengths[used]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[used] - (ends - size), size)
        return pool[at], np.concatenate([[0], ends[edges + np.arange(len(texts))]])

    def _ids(self, words: list[str]) -> list[list[int]]:
        known, model = self.known, self.tokenizer.model
        fresh = [w for w in words if w not in known]
        rest = [w for w in fresh if not (w.isascii() and w.isalpha())]
        known.update((w, [t.id for t in model.tokenize(w)]) for w in fresh if w.isascii() and w.isalpha())
        mark, mark_id = next(iter(self.special.items()), ("", -1))
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            joined = [*self.tokenizer.encode(mark.join(some), add_special_tokens=False).ids, mark_id]
            a = 0
            for w, b in zip(some, np.flatnonzero(np.array(joined) == mark_id).tolist()):
                known[w] = joined[a:b]
                a = b + 1
        out = list(map(known.__getitem__, words))
        if len(known) > WORDS:
            known.clear()
        for w in fresh:
            if len(w) > LONG:
                known.pop(w, None)
        return out


def _words(texts: pa.Array) -> pa.Array:
    """Lower-case words between ASCII white space; ASCII letters and ASCII signs (but the apostrophe) are words apart."""
    plain = pc.ascii_lower(texts)
    for pattern in (f"([a-z])([{SIGNS}])", f"([{SIGNS}])([a-z])"):
        plain = pc.replace_substring_regex(plain, pattern, r"\1 \2")
    return pc.ascii_split_whitespace(plain)


_TOKENS: dict[str, Tokens] = {}


def pieces(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts, stored: ``kept`` (a struct), piece, start, length, ids_crc32, ids where asked for, and place,
    a number of the row that was given when it was written."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    source = docs.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"), F.col(text).alias("text"))
    ids_type = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    out = T.StructType([
        T.StructField("kept", source.schema["kept"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *ids_type,
    ])

    def cut(batches):
        file = SparkFiles.get(name)
        if file not in _TOKENS:
            _TOKENS[file] = Tokens(file)
        tokens = _TOKENS[file]
        for batch in batches:
            for low, high in portions(batch.column(1), PORTION):
                ids, edges = tokens.of(batch.column(1).slice(low, high - low), end)
                n = np.diff(edges)
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(n[row] - start, size)
                a = edges[row] + start
                crc = [zlib.crc32(ids[x : x + k].astype("<u4").tobytes()) for x, k in zip(a.tolist(), length.tolist())]
                columns = [batch.column(0).slice(low, high - low).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:  # pieces lie in the order of the ids, without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, edges[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return stored(source.mapInArrow(cut, out).withColumn("place", F.monotonically_increasing_id()), "pieces")


class Room:
    """Segment tree over room 0..size: whether sequences with that room are open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.open[at] = int(is_open)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that is open."""
        at = length + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Steps (length, first rank, first sequence, pieces in each, offset of the first of them) of best-fit decreasing."""
    steps, room, used = [], Room(size), 0
    ranges: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number of them

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            ranges.setdefault(left, []).append((first, many))
            room.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            space = room.tightest(length)
            if space is None:
                space, first, many = size, used, -(-rest // (size // length))
                used += many
            else:
                first, many = ranges[space].pop()
                if not ranges[space]:
                    room.set(space, False)
            each = space // length
            steps.append((length, rank, first, each, size - space))
            full, odd = divmod(min(rest, many * each), each)
            put(space - each * length, first, full)
            if odd:
                put(space - odd * length, first + full, 1)
            put(space, first + full + (odd > 0), many - full - (odd > 0))
            rank, rest = rank + full * each + odd, rest - full * each - odd
    return np.array(steps, np.int64).reshape(-1, 5)


def packed(made: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (a stored table with length and place) with sequence_id and offset."""
    spark = made.sparkSession
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``size`` rows
    steps = spark.sparkContext.broadcast(plan(counts, size))
    slices = [-(-counts.get(n, 0) // SLICE) or 1 for n in range(1, size + 1)]
    of_length = F.element_at(F.array(*[F.lit(s) for s in slices]), F.col("length").cast("int"))
    sliced = made.withColumn("slice", F.pmod(F.xxhash64("place"), of_length))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("length", "slice").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("length", "slice").orderBy("place")
    ranked = sliced.join(totals.drop("count"), ["length", "slice"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("before"))
    names = made.columns
    ranked = ranked.select(*names, "rank")
    out = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        length, first_rank, first, each, offset = steps.value.T
        order = np.lexsort((first_rank, length))
        key = (length << 48) + first_rank
        key = key[order]
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = order[np.searchsorted(key, (n << 48) + rank, side="right") - 1] if len(key) else np.zeros(0, int)
            k = rank - first_rank[at]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * n)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, out)


def kept(frame: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns under their own names, then the others."""
    return frame.select(*[F.col("kept")[f"k{i}"].alias(c) for i, c in enumerate(keep)], *[c for c in frame.columns if c not in ("kept", "place")])


def sequences(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """The packed sequences: sequence_id, ids, and members (kept, piece, start, length, offset) in their order."""
    made = packed(pieces(docs, keep, tokenizer, text, size, end, with_ids=True), size)
    member = F.struct("offset", "length", "kept", "piece", "start", "ids")
    rows = made.groupBy("sequence_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    return rows.select(
        "sequence_id", F.flatten("members.ids").alias("ids"),
        F.transform("members", lambda m: F.struct(m["kept"].alias("kept"), *[m[c].alias(c) for c in ("piece", "start", "length", "offset")])).alias("members"),
    )
