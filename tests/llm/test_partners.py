"""Lines that meet in a tile without being alike cost no pair, no text and no place in the tables of links."""

import numpy as np
import pyarrow as pa
import pytest

from pressgauge.llm import components, lines, partners, sketches
from pressgauge.llm.frames import stored, table

SF = "/root/testdata/sf0.001"


def sets(seed, tiles, most):
    random, out = np.random.default_rng(seed), []
    for tile in range(tiles):
        base = random.integers(0, 1 << 62, int(random.integers(1, 400)), dtype=np.uint64)
        for i in range(int(random.integers(1, most))):
            own = base[random.random(len(base)) < random.choice([0.97, 0.6, 0.3])]
            out.append((tile * 7919 - 300_000, np.unique(np.concatenate([own, random.integers(0, 1 << 62, int(random.integers(1, 30)), dtype=np.uint64)]))))
    return out


def allowed(a, b):
    n, m = len(a), len(b)
    bits = sketches.apart(sketches.sketch(a, 1), sketches.sketch(b, 1))
    return 100 * min(n, m) >= 80 * max(n, m) and bool(sketches.close(n, m, bits, 80))


@pytest.mark.parametrize("near, words, large", [(16, 1 << 18, 1 << 17), (1, 64, 1 << 17), (2, 32, 20)])
def test_partners_are_those_of_all_pairs(monkeypatch, near, words, large):
    """Tiles that are too large stay whole."""
    monkeypatch.setattr(partners, "LARGE", large)
    monkeypatch.setattr(partners, "NEAR", near)
    monkeypatch.setattr(partners, "WORDS", words)
    rows = sorted(sets(near, 70, 30), key=lambda r: (r[0], len(r[1])))
    maps = [sketches.sketch(s, 1) for _, s in rows]
    tiles, n, sizes = (np.array(x) for x in ([t for t, _ in rows], [len(s) for _, s in rows], [len(x) for x in maps]))
    assert (sketches.map_bits(n, 1) == 8 * sizes).all()
    found = partners.with_partner(tiles, n, sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(maps), np.uint8), 80)
    wanted = [sum(tiles == tiles[i]) > large or any(k != i and t == tiles[i] and allowed(s, rows[i][1]) for k, (t, s) in enumerate(rows)) for i in range(len(rows))]
    assert 100 < sum(wanted) < len(rows) - 100 and found.tolist() == wanted


def test_partners_of_dealt_rows(spark):
    """Whatever packs they come in, and with ids that have several rows."""
    rows = [(i, t, s) for i, (t, s) in enumerate(sets(5, 30, 12))]
    made = [(i, len(s), sketches.sketch(s, 1), t, -t - 5 if i % 3 else i + 10**9) for i, t, s in rows for _ in range(1 + i % 2)]
    frame = spark.createDataFrame(made, "id long, n long, sketch binary, one long, two long").repartition(4)
    found = partners.partnered(frame, ["one", "two"], 80, 1, 5)
    tiles = {}
    for i, _, _, one, two in made:
        for tile in (one, two):
            tiles.setdefault(tile, set()).add(i)
    wanted = {(tile, a) for tile, ids in tiles.items() for a in ids if any(a != b and allowed(rows[a][2], rows[b][2]) for b in ids)}
    got = [tuple(r) for f in found for r in f.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    empty = partners.partnered(frame.limit(0), ["one", "two"], 80, 1, 5)
    assert sum(f.count() for f in empty) == 0


def test_one_short_line_does_not_fold_the_maps_of_its_block():
    random = np.random.default_rng(3)
    own = [np.unique(random.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (7, 40, 90, *[380] * 60, *[520] * 60)]
    block = {"n": np.array([len(s) for s in own]), "sketch": np.array([sketches.sketch(s, 1) for s in own], object)}
    half = {name: x[::2] for name, x in block.items()}
    wanted = {(i, j) for i in range(len(own)) for j in range(len(own)) if i < j and allowed(own[i], own[j])}
    i, j, far = sketches.plausible(block, block, 80)
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == wanted and len(i) == len(wanted) < 50
    i, j, far = sketches.plausible(block, half, 80)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(own)) for b in range(len(half["n"])) if allowed(own[a], own[2 * b])]


def test_texts_are_fetched_of_lines_with_partners_only(spark, monkeypatch):
    docs, seen, line_texts = table(spark, SF, "documents"), [], lines.line_texts
    monkeypatch.setattr(lines, "line_texts", lambda docs, ids, *a: seen.append({r[0] for r in ids.collect()}) or line_texts(docs, ids, *a))
    banded = stored(lines.line_rows(docs, "doc_id", "text", "doc_id"), "line-bands")
    tiles = {}
    for r in banded.where("n IS NOT NULL").collect():
        for band in lines.BAND:
            tiles.setdefault(r[band], set()).add(r["id"])
    meeting = {i for ids in tiles.values() if len(ids) > 1 for i in ids}
    linked = {r["id"] for r in lines.groups(banded, docs, "text").collect()}
    assert linked and linked <= seen[0] <= meeting
    assert len(seen[0] - linked) < 0.2 * len(meeting - linked)  # those whose maps allow what their texts do not


def test_shingles_of_lines_where_they_stand():
    """Sizes and maps of the first pass are those of the texts that are compared in the end."""
    texts = pa.array(["one line of text\naaaaaaaaaaaa\nabc\n\nÄÖ und Ähnliches", None, "日本語の長い行です\nx"])
    for short in (False, True):
        found = lines.Lines(texts, short)
        those = np.flatnonzero(found.compared)
        own = pa.array([found.data[found.low[k] : found.high[k]].tobytes().decode() for k in those])
        for a, b in zip(lines.distinct(*found.shingles(those)), lines.shingle_runs(own)):
            assert (a == b).all()


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_components_of_few_links_and_of_many(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    random = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in random.integers(-40, 40, (45, 2)) * 10**15] + [(k, k + 1) for k in range(500, 530)]
    least = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(least.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    found = spark.createDataFrame(sorted(least.items()), "id long, component long")
    more = [(1000, 1001), (1001, 510), (530, links[0][0]), (2000, 2001), (501, 507), (links[3][0], 2001)]
    for x in {x for pair in more for x in pair}:
        least.setdefault(x, x)
    for _ in least:
        for a, b in links + more:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    merged = components.merged(found, spark.createDataFrame(more, "a long, b long"))
    assert sorted(tuple(r) for r in merged.collect()) == sorted(least.items())
