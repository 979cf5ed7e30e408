"""Connected components, and the search for links within tiles, both as distributed joins.

``components`` alternates large-star and small-star steps (a distributed union-find) until only stars are left; each step is a
table in the shared folder. Up to FEW_LINKS links need no such steps. ``resolve`` finds the components of a graph whose links must be verified, when any linked two
ids share a tile, without making all pairs of a large tile:

1. each id is compared with one leader it shares a tile with;
2. twice: in tiles that still hold several components, each component's LIKELIEST pairs with others. Any tiles do for
   this, so each id takes part in FEW of its tiles only;
3. what is left, ids of one tile in different components, exhaustively: in blocks of BLOCK ids, where a bound from above
   (``plausible``) comes first and only pairs that pass it are verified.

Pairs within one component need no check, since they cannot change it. So no link between components is lost. Each table's
shuffle files go when it is written, so the disk holds those of one step at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import discard, stored
from .sketches import plausible, plausible_pairs

BLOCK = 512
FEW, LIKELIEST = 4, 3
FEW_LINKS = 1 << 16  # links whose components the driver finds, 1 MB
SMALL = 64  # ids of a tile; smaller tiles are compared many at a time


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs; returns (id, component) for every id with a link, component being the smallest id."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges", tidy=True)
    if edges.count() <= FEW_LINKS:
        found = _few(edges)
        discard(edges)
        return found
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges, old = stored(small.distinct(), "edges", tidy=True), edges
        discard(old)
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))


def _few(links: DataFrame) -> DataFrame:
    """``components`` of links that the driver holds."""
    table, least = links.toArrow(), {}

    def root(x: int) -> int:
        while least.setdefault(x, x) != x:
            least[x] = x = least[least[x]]
        return x

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    found = pa.table({"id": pa.array(list(least), pa.int64()), "component": pa.array([root(x) for x in list(least)], pa.int64())})
    return links.sparkSession.createDataFrame(found, "id long, component long")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` after more links, of which only those between two components are looked at."""
    a, b = (found.select(F.col("id").alias(x), F.col("component").alias(f"component {x}")) for x in "ab")
    both = links.join(a, "a", "left").join(b, "b", "left")
    both = both.select(F.coalesce("component a", "a").alias("a"), F.coalesce("component b", "b").alias("b"))
    joined = components(both)
    new = joined.join(found, "id", "left_anti")
    known = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("less")), "component", "left")
    return known.select("id", F.coalesce("less", "component").alias("component")).unionByName(new)


def _stars(edges: DataFrame) -> bool:
    """Whether every id points at one smaller id only, and that at none: then that is its component's smallest."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("out")))
    counts = ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return counts.where("out > 1 OR (out = 1 AND least = 0)").isEmpty()


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def resolve(tiles: DataFrame, known: Callable[[DataFrame], tuple[Callable, DataFrame]], percent: int) -> DataFrame:
    """(id, component) of all ids with a link. ``tiles``: (tile, id) longs, repeats allowed.

    ``known`` takes the ids that share a tile with another and returns ``verify``, which takes distinct (a, b) pairs and
    returns those that are links, and ``attributes``, a table by id: n and sketch (``sketches``), by which pairs that are not
    ``percent`` similar are told.
    """
    by_tile = Window.partitionBy("tile")
    led = tiles.withColumn("leader", F.min("id").over(by_tile)).withColumn("last", F.max("id").over(by_tile)).where("leader < last")
    rows = stored(led.select("tile", "id", "leader").distinct(), "tiles", tidy=True)
    verify, attributes = known(rows.select("id").distinct())

    first = rows.where("leader < id").groupBy("id").agg(F.min("leader").alias("b"))
    tried = stored(first.select(*_pairs(F.col("id"), F.col("b"))), "pairs", tidy=True)
    links = stored(verify(tried), "links", tidy=True)
    found = stored(components(links), "components", tidy=True)
    discard(links)
    spent = [tried]

    for last in (False, False, True):
        placed = rows.select("tile", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = placed.withColumn("smallest", F.min("component").over(by_tile)).withColumn("largest", F.max("component").over(by_tile)).where("smallest < largest")
        rows, old = stored(mixed, "mixed", tidy=True), rows
        mixed = rows
        discard(old)
        pairs = _across(mixed, attributes, percent, every=last)
        new = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs", tidy=True)
        tried = tried.unionByName(new)
        spent.append(new)
        more = stored(verify(new), "links", tidy=True)
        if more.isEmpty():
            discard(more)
            continue
        found, old = stored(merged(found, more), "components", tidy=True), found
        discard(old, more)
    discard(rows, *spent)
    return found


def _across(mixed: DataFrame, attributes: DataFrame, percent: int, every: bool) -> DataFrame:
    """Plausible pairs of ids of one tile and different components, from blocks of the tile taken two at a time."""
    by_tile = Window.partitionBy("tile")
    rows = mixed.select("tile", "id", "component").distinct()
    if not every:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("tile"))).where(F.col("rank") <= FEW)
    rows = rows.withColumn("block", F.floor((F.row_number().over(by_tile.orderBy("id")) - 1) / BLOCK)).withColumn("blocks", F.max("block").over(by_tile))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
    rows = rows.select("tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component")

    def compared(batches):
        """Groups of (tile, low, high) come one after the other, none of more than two blocks; one may go on in the next
        batch."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            groups = np.column_stack([table.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1
            yield from _block_pairs(table, [0, *edges], percent, every)
            rest = table.slice(edges[-1] if len(edges) else 0)
        if rest is not None:
            yield from _block_pairs(rest, [0, rest.num_rows], percent, every)

    rows = rows.join(attributes, "id").select(*rows.columns, *[c for c in attributes.columns if c != "id"]).repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high")
    pairs = rows.mapInArrow(compared, "x long, y long")
    return pairs.select(*_pairs(F.col("x"), F.col("y")))


def _block_pairs(table: pa.Table, edges: list[int], percent: int, every: bool):
    """Pairs of all groups but what follows the last edge; all of them, or the likeliest of each component."""
    columns = {n: table.column(n).to_numpy() if table.schema.field(n).type != pa.binary() else np.array(table.column(n).to_pylist(), object) for n in table.column_names[1:]}
    out, sizes = [np.zeros((0, 2), np.int64)], np.diff(edges)

    def chosen(left, right, i, j, distance, group):
        ours, theirs = left["component"][i], right["component"][j]
        keep = np.flatnonzero(ours != theirs)
        if not every and len(keep):
            group, distance = group[keep], distance[keep]
            keep = np.union1d(_nearest(keep, group, ours[keep], distance), _nearest(keep, group, theirs[keep], distance))
        out.append(np.column_stack([left["id"][i[keep]], right["id"][j[keep]]]))

    heads = np.array(edges[:-1], np.int64)
    small = (sizes <= SMALL) & (columns["low"][heads] == columns["high"][heads])
    if small.any():
        # the pairs of all small tiles, each row with those after it
        at = np.concatenate([np.arange(low, low + n) for low, n in zip(heads[small], sizes[small])])
        later = np.repeat(heads[small] + sizes[small], sizes[small]) - at - 1
        i = np.repeat(at, later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        apart = columns["component"][i] != columns["component"][j]
        i, j, distance = plausible_pairs(columns, i[apart], j[apart], percent)
        chosen(columns, columns, i, j, distance, np.searchsorted(heads, i, "right"))
    for a, n in zip(heads[~small], sizes[~small]):
        own = {name: c[a : a + n] for name, c in columns.items()}
        left = right = own
        if own["low"][0] != own["high"][0]:
            left, right = ({name: c[own["block"] == own[side][0]] for name, c in own.items()} for side in ("low", "high"))
        if len(left["id"]) and len(right["id"]):
            i, j, distance = plausible(left, right, percent)
            chosen(left, right, i, j, distance, np.zeros(len(i), np.int64))
    found = np.concatenate(out)
    found = np.unique(np.sort(found, axis=1), axis=0)  # a pair may share several tiles
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "y"])


def _nearest(pairs: np.ndarray, group: np.ndarray, component: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The LIKELIEST pairs of each component of each group."""
    order = np.lexsort((distance, component, group))
    first = np.flatnonzero(np.append(True, (np.diff(component[order]) != 0) | (np.diff(group[order]) != 0)))
    rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
    return pairs[order[rank < LIKELIEST]]
