"""Clustering, vector codes and packing against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from odd import documents, rows as odd_rows
from pyspark.sql import functions as F

from pressgauge.llm import clustering, codes, packing
from pressgauge.llm.frames import table
from pressgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ", cluster string, distance string, code string, error string, kept string, data string, change string"


def nearest(x, centers):
    apart = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centers]
    return apart.index(min(apart)), min(apart)


def lloyd(vectors, centers, rounds):
    """Plain Lloyd with Python integers: centroids, clusters and distances."""
    for _ in range(rounds):
        found = [nearest(x, centers)[0] for x in vectors]
        for c in range(len(centers)):
            own = [x for x, f in zip(vectors, found) if f == c]
            if own:
                centers = [*centers[:c], [sum(v) // len(own) for v in zip(*own)], *centers[c + 1 :]]
    return centers, [nearest(x, centers) for x in vectors]


def named(i, seed=3):
    return hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()


def whole(vector, scale):
    return [int(np.floor(float(np.float64(v)) * scale)) for v in vector]


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [whole(v, scale) for _, v in rows]
    width = len(ints[0]) // parts
    books, code, error = [], [""] * len(rows), [0] * len(rows)
    for p in range(parts):
        cut = [x[p * width : (p + 1) * width] for x in ints]
        book, found = lloyd(cut, cut[:entries], rounds)
        books.append(book)
        for i, (c, d) in enumerate(found):
            code[i] += f"{c:02x}"
            error[i] += d
    return rows, books, code, error


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_clusters_of_the_query(spark, sf):
    got = {r["vec_id"]: r for r in QUERIES["op11_clusters"](spark, f"/root/testdata/sf{sf}").collect()}
    rows = [(r["vec_id"], whole(r["embedding"], 1024)) for r in table(spark, f"/root/testdata/sf{sf}", "embeddings").collect()]
    first = [x for _, x in sorted(rows, key=lambda r: named(r[0]))[:8]]
    centers, found = lloyd([x for _, x in rows], first, 10)
    inertia = [sum(d for c, d in found if c == k) for k in range(8)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    assert len(got) == len(rows)
    for (i, _), (c, d) in zip(rows, found):
        assert tuple(got[i]) == (i, c, d, inertia[c], sum(inertia), digests[c])


def test_codes_of_the_query(spark):
    got = {r["vec_id"]: r for r in QUERIES["op12_codes"](spark, SF).collect()}
    data = table(spark, SF, "embeddings").collect()
    rows, books, code, error = brute_codes([(r["vec_id"], list(r["embedding"])) for r in data])
    label = {r["vec_id"]: r["label"] for r in data}
    sums = {}
    for (i, _), e in zip(rows, error):
        sums[label[i]] = sums.get(label[i], 0) + e
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    for (i, _), c, e in zip(rows, code, error):
        assert tuple(got[i]) == (i, c, e, sums[label[i]], digest)
    assert len(got) == len(rows)


def lumpy(n, dims, seed, large=1.0):
    """Vectors with many exact ties, copies, and clusters of very different sizes."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dims))
    rows = centers[rng.choice(5, n, p=[0.6, 0.2, 0.1, 0.05, 0.05])] + rng.normal(size=(n, dims)) * rng.choice([0, 0.01, 0.4], (n, 1))
    return (np.round(rows * 8) / 8 * large).tolist()


@pytest.mark.parametrize("large", [1.0, 1e4, 1e9])
def test_clusters_equal_lloyd(spark, large):
    """Ties, copies, and magnitudes beyond exact doubles and beyond the limit."""
    vectors = lumpy(900, 6, 5, large)
    frame = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").repartition(3)
    found, centers, inertias = clustering.cluster(frame, "v", "id", ["id"], k=7, dims=6, rounds=8, scale=16, seed=1)
    limit = int(clustering.scaled(np.array([1e300]), 1, 6)[0])
    ints = [[max(-limit, min(limit, x)) for x in whole(v, 16)] for v in vectors]
    first = [ints[i] for i in sorted(range(len(ints)), key=lambda i: (named(i, 1), i))[:7]]
    wanted, placed = lloyd(ints, first, 8)
    assert centers == wanted
    assert {r["id"]: (r["cluster"], r["distance"]) for r in found.collect()} == dict(enumerate(placed))
    assert inertias == [sum(d for c, d in placed if c == k) for k in range(7)]


@pytest.mark.parametrize("large", [1.0, 1e5])
def test_codes_equal_lloyd(spark, large):
    vectors = lumpy(700, 8, 6, large)
    frame = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], "id long, v array<double>, label int").repartition(3)
    coded, books = codes.encode(frame, "v", "id", ["id"], parts=4, entries=9, rounds=5, scale=32)
    _, wanted, code, error = brute_codes(list(enumerate(vectors)), 4, 9, 5, 32)
    assert books.tolist() == wanted
    assert {r["id"]: (r["code"], r["error"]) for r in coded.collect()} == {i: x for i, x in enumerate(zip(code, error))}


def test_few_vectors_are_popped_late(spark):
    """The bounds spare work: after centroids have settled, hardly a vector is scanned again."""
    x = (np.array(lumpy(600, 6, 9)) * 16).astype(np.int16)
    centers, drift, state, scanned = x[:5].astype(np.int64), np.zeros(5), {}, []
    for _ in range(12):
        pops = []
        real = clustering.squared
        clustering.squared = lambda a, c: pops.append(len(a)) or real(a, c)
        try:
            cluster, heaps, _ = clustering.assigned(x, state, centers, drift)
        finally:
            clustering.squared = real
        keys, members = heaps.packed()
        for heap in heaps.keys:  # each is a heap
            assert all(heap[(i - 1) // 2] <= heap[i] for i in range(1, len(heap)))
        state = {"cluster": cluster.tobytes(), "keys": keys, "members": members}
        scanned.append(sum(pops))
        placed = np.array([x[cluster == c].astype(np.int64).sum(0) // max((cluster == c).sum(), 1) for c in range(5)])
        moves = np.sqrt(((placed - centers) ** 2).sum(1))
        drift = drift + moves + np.array([np.delete(moves, c).max() for c in range(5)]) + clustering.SLACK
        centers = placed
    assert scanned[0] == 600 and scanned[-1] < 60


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(i * j % 7) for j in range(64)] for i in range(4)]
    rows = [(0, good[0], 1), (1, good[1], None), (1, good[1], None), (2, None, 1), (3, [], 1), (4, [1.0] * 63, None), (5, [None] * 64, 1), (6, [nan] * 64, 2)]
    rows += [(7, [inf] + [0.0] * 63, 2), (None, good[2], 5), (8, [1e30] * 64, 9), (9, [1.0] * 128, 1)]
    return spark.createDataFrame([(*r, *["x"] * EXTRA.count(",")) for r in rows], "vec_id long, embedding array<float>, label int" + EXTRA)


def test_odd_vectors(spark):
    frame = odd_vectors(spark)
    found, centers, inertias = clustering.cluster(frame, "embedding", "vec_id", ["vec_id", "cluster", "data"])
    assert found.columns == ["vec_id", "cluster", "data", "cluster", "distance"] and len(centers) == 5
    assert sorted(str(r[0]) for r in found.collect()) == ["0", "1", "1", "8", "None"]
    assert max(r["distance"] for r in clustering.cluster(frame, "embedding", "vec_id", ["vec_id"], k=1)[0].collect()) > 1 << 50
    none, _, _ = clustering.cluster(frame.limit(0), "embedding", "vec_id", ["vec_id"])
    assert clustering.labelled(none, [], []).count() == 0

    coded, _ = codes.encode(frame, "embedding", "vec_id", ["vec_id", "label", "code"])
    assert coded.columns == ["vec_id", "label", "code", "code", "error"]
    coded, _ = codes.encode(frame, "embedding", "vec_id", ["vec_id", "label"])
    by = {}
    for r in codes.with_label_errors(coded, "label", "vec_id").collect():
        by.setdefault(r["vec_id"], []).append((r["code"], r["error"], r["label_error"]))
    assert set(by) == {0, 1, 3, 4, 8, 9, None} and len(by[1]) == 2 and by[1][0] == by[1][1]
    assert all(by[k] == [(None, None, by[k][0][2])] for k in (3, 4, 9)) and all(len(by[k][0][0]) == 16 for k in (0, 1, 8, None))
    nothing, books = codes.encode(frame.limit(0), "embedding", "vec_id", ["vec_id", "label"])
    assert codes.with_label_errors(nothing, "label", "vec_id").count() == 0 and len(codes.digest(books)) == 64


def test_only_vectors_that_cannot_be_coded(spark):
    frame = spark.createDataFrame([(1, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int")
    coded, _ = codes.encode(frame, "embedding", "vec_id", ["vec_id", "label"])
    assert [tuple(r) for r in codes.with_label_errors(coded, "label", "vec_id").collect()] == [(1, 1, None, None, 0)]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def check_packing(rows, size, wanted):
    """Rows (piece key, length, sequence, offset) fill sequences without gaps; as few as best-fit decreasing one by one."""
    by = {}
    for n, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, n))
    for members in by.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= size
    assert len(by) == wanted


def best_fit(lengths, size):
    """Best-fit decreasing, one piece at a time: room of every sequence, sorted."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(size - n)
        else:
            room[room.index(fit)] = fit - n
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for size in (1, 7, 64, 100):
        for _ in range(40):
            lengths = [rng.randint(1, rng.choice([size, max(1, size // 3)])) for _ in range(rng.choice([0, 1, 40, 400]))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            steps = packing.plan(counts, size)
            starts = {}
            for length, first_rank, first, each, offset in steps.tolist():
                starts.setdefault(length, []).append((first_rank, first, each, offset))
            placed = []
            for length, many in counts.items():
                for rank in range(many):
                    r0, first, each, offset = max(s for s in starts[length] if s[0] <= rank)
                    placed.append((length, first + (rank - r0) // each, offset + (rank - r0) % each * length))
            room = best_fit(lengths, size)
            check_packing(placed, size, len(room))
            used = {}
            for n, sequence, _ in placed:
                used[sequence] = used.get(sequence, 0) + n
            assert sorted(size - u for u in used.values()) == room


def test_segment_tree():
    rng = random.Random(3)
    room, have = packing.Room(50), set()
    for _ in range(2000):
        r = rng.randint(0, 50)
        room.set(r, r not in have)
        have ^= {r}
        n = rng.randint(0, 50)
        assert room.tightest(n) == min((h for h in have if h >= n), default=None)


def test_ids_are_the_tokenizer_s(spark):
    """Words between ASCII white space give the same ids as whole texts."""
    rng = random.Random(11)
    odd = ["don't", "A.b", "x_y", "C++", "<|STARTOFTEXT|>", "O'Neil's.", "a-́b", "É", "é", "́", "ΑΣ", "İ", "ǅ", "<|endoftext|>", "a<|endoftext|>b", " ", " x", "\u0085", "漢字", "かな", "x9", "'s", "'", "--'ll", "\x1c", "🙂", "가", "ﬁ", " ", "Ω", "ſ", "…", "½", "\x00"]
    texts = ["".join(rng.choice([*odd, " ", "\n", "\t", "\r", "\x0b", "\x0c", "word"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    tokens = packing.Tokens(TOKENIZER)
    import pyarrow as pa

    plain = tokenizer()
    assert tokens.by_word
    for some in (texts, [None, "", *texts[:5], None], [], ["<|endoftext|>"], ["<|ENDOFTEXT|> İİ ǨK"]):
        ids, edges = tokens.of(pa.array(some, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in some]
    # letters with every combining mark, in both cases
    marks = [chr(m) for m in [*range(0x300, 0x370), 0x1AB0, 0x20D0, 0x3099]]
    some = [" ".join(a + m for m in marks) for a in "aAiIkKsSzZ.-'"]
    ids, edges = tokens.of(pa.array(some), 1)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in some]


def test_other_tokenizers_take_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    tokens, plain = packing.Tokens(file), Tokenizer.from_file(file)
    some = ["two words", None, " A  b\n", "a<|endoftext|>b"]
    ids, edges = tokens.of(pa.array(some), 7)
    assert not tokens.by_word
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [plain.encode(t or "", add_special_tokens=False).ids + [7] for t in some]


def test_packing_of_the_query(spark):
    got = QUERIES["op13_packing"](spark, SF).collect()
    plain, wanted = tokenizer(), []
    for r in table(spark, SF, "documents").collect():
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            wanted.append((r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(wanted)
    check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in got], 4096, len(best_fit([w[3] for w in wanted], 4096)))


def test_sequences_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 3)  # many slices of one length
    docs = documents(spark)
    made = packing.pieces(docs, ["doc_id", "n", "key"], TOKENIZER, size=50)
    found = packing.kept(packing.packed(made, 50), ["doc_id", "n", "key"])
    assert found.columns == ["doc_id", "n", "key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = found.collect()
    plain = tokenizer()
    lengths = []
    for r in odd_rows():
        n = len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1
        lengths += [50] * (n // 50) + [n % 50] * (n % 50 > 0)
    assert sorted(lengths) == sorted(r["length"] for r in got)
    check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in got], 50, len(best_fit(lengths, 50)))
    whole = packing.sequences(docs, ["doc_id"], TOKENIZER, size=50).collect()
    by = {}
    for r in whole:
        assert len(r["ids"]) == sum(m["length"] for m in r["members"]) <= 50
        for m in r["members"]:
            by.setdefault(m["kept"]["k0"], []).append((m["start"], r["ids"][m["offset"] : m["offset"] + m["length"]]))
    for k, text in ((5, None), (9, None), (11, None)):
        text = next(r[1] for r in odd_rows() if r[0] == k)
        assert [i for _, part in sorted(by[k]) for i in part] == plain.encode(text, add_special_tokens=False).ids + [1]
    assert by[1] == by[2] == [(0, [1])]
    assert packing.packed(packing.pieces(docs.where(F.lit(False)), ["doc_id"], TOKENIZER)).count() == 0
