"""Per-domain politeness: which requests keep the crawl delay.

A request is allowed when at least ``delay`` has passed since the last *fetch*
of its domain. Only allowed requests that got a response move the clock, so the
decision is sequential. To keep a domain with most of the requests out of one
task, time is cut into slices:

1. per (domain, slice): for each request that could be the slice's first fetch,
   the last fetch that follows from it (a few rows per slice);
2. per domain: walk those rows from slice to slice, giving the clock at the
   start of each slice;
3. per (domain, slice): decide every request from that clock.

Steps 1 and 3 run in parallel over slices and read sorted batches with constant
memory. Step 2 sees only requests from the first ``delay`` of each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pressgauge import settings

SLICE_DELAYS = 4096  # slice length in delays
NO_FETCH = np.iinfo(np.int64).min // 2


def effective_delay(delay: Column, default: float = settings.DEFAULT_CRAWL_DELAY) -> Column:
    """Seconds; none or zero means the default."""
    return F.coalesce(F.nullif(delay.cast("double"), F.lit(0.0)), F.lit(default))


def sliced(requests: DataFrame, slice_delays: int) -> DataFrame:
    """Narrow request rows: domain, job_id, t and delay in microseconds, slice, moves."""
    t = F.unix_micros(F.col("requested_at").cast("timestamp"))
    d = (effective_delay(F.col("delay")) * 1_000_000).cast("long")
    moves = F.col("fetched") if "fetched" in requests.columns else F.lit(True)
    rows = requests.select("domain", F.col("job_id").cast("long").alias("job_id"), t.alias("t"), d.alias("d"), F.coalesce(moves, F.lit(False)).alias("moves"))
    return rows.withColumn("slice", F.expr(f"t div (d * {int(slice_delays)})"))


def runs(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, slice]]:
    """Cut a sorted batch at key changes."""
    columns = [batch[k].to_numpy() for k in keys]
    changed = np.zeros(len(batch), dtype=bool)
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
    cuts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield tuple(column[a] for column in columns), slice(a, b)


def _advance(clock: np.ndarray, times: np.ndarray, d: int) -> np.ndarray:
    """Follow every clock through the sorted fetch times as far as they go."""
    heads, back = np.unique(clock, return_inverse=True)
    while len(times):
        at = np.searchsorted(times, heads + d, side="left")
        can = at < len(times)
        if not can.any():
            break
        heads[can] = times[at[can]]
        clock = heads[back]
        heads, back = np.unique(clock, return_inverse=True)
    return heads[back]


EXITS = ["domain", "slice", "d", "first_fetch", "last_fetch"]


def _numbered(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted batch the number of its (domain, slice), and the places where these begin."""
    changed = np.zeros(len(batch), dtype=bool)
    changed[:1] = True
    for column in (batch["domain"].to_numpy(), batch["slice"].to_numpy()):
        changed[1:] |= column[1:] != column[:-1]
    opens = np.flatnonzero(changed)
    return np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(batch)))), opens


def _first_at(times: np.ndarray, group: np.ndarray, wanted: np.ndarray, wanted_group: np.ndarray) -> np.ndarray:
    """The place of the first time of each wanted group that is not before the wanted one; len(times) if there is none.

    Groups ascend, and times within them. All groups are searched at once, by sorting what is wanted in between.
    """
    n = len(times)
    late = np.append(np.ones(n, dtype=bool), np.zeros(len(wanted), dtype=bool))
    order = np.lexsort((late, np.append(times, wanted), np.append(group, wanted_group)))
    asks = order >= n
    at = np.empty(len(wanted), dtype=np.int64)
    at[order[asks] - n] = np.cumsum(~asks)[asks]
    return np.where(np.append(group, -1)[at] == wanted_group, at, n)


def _whole_exits(batch: pd.DataFrame, slice_delays: int) -> pd.DataFrame:
    """The exits of slices that lie in the batch as wholes, all at once."""
    group, opens = _numbered(batch)
    moving = batch["moves"].to_numpy().astype(bool)
    rows, g = batch[moving], group[moving]
    t, d = rows["t"].to_numpy(), rows["d"].to_numpy()
    n, opening = len(rows), np.append(True, g[1:] != g[:-1])[: len(g)]
    early = t < rows["slice"].to_numpy() * d * slice_delays + d
    # any fetch in the first delay may come first; so may the one right after it
    first = early | opening | np.append(True, early[:-1])[:n]
    first &= opening | np.append(True, t[1:] != t[:-1])[:n]
    up = _first_at(t, g, t + d, g)
    up = np.where(up == n, np.arange(n), up)  # the last fetch of a chain points to itself
    while not ((further := up[up]) == up).all():
        up = further
    out = rows[["domain", "slice", "d"]].assign(first_fetch=t, last_fetch=t[up])[first]
    idle = np.setdiff1d(np.arange(len(opens)), g)  # slices without fetches still pass the clock on
    return pd.concat([out, batch.iloc[opens[idle]][["domain", "slice", "d"]].assign(first_fetch=NO_FETCH, last_fetch=NO_FETCH)], ignore_index=True)


def _slice_exits(slice_delays: int):
    """Per (domain, slice): every request that may be its first fetch, and the last fetch that leads to.

    Only the slices at a batch's ends may go on in another one: they are followed with a state, all others at once.
    """

    def begin(key: tuple, d: int) -> dict:
        return {
            "key": key, "d": d, "open_until": int(key[1]) * d * slice_delays + d, "closed": False,
            "starts": np.empty(0, np.int64), "clock": np.empty(0, np.int64),
        }

    def finish(state: dict) -> pd.DataFrame:
        none = np.array([NO_FETCH], dtype=np.int64)  # a slice without fetches still passes the clock on
        starts, clock = (state["starts"], state["clock"]) if len(state["starts"]) else (none, none)
        n = len(starts)
        return pd.DataFrame({
            "domain": np.repeat(state["key"][0], n), "slice": np.repeat(state["key"][1], n),
            "d": np.repeat(state["d"], n), "first_fetch": starts, "last_fetch": clock,
        })[EXITS]

    def follow(state: dict, rows: pd.DataFrame) -> None:
        times = rows["t"].to_numpy()[rows["moves"].to_numpy().astype(bool)]
        if not len(times):
            return
        # Any fetch in the first delay may come first; so may the one right after it.
        new = times[:0]
        if not state["closed"]:
            k = int(np.searchsorted(times, state["open_until"], side="left"))
            state["closed"] = k < len(times)
            new = np.unique(times[: k + 1])
            if len(state["starts"]):
                new = new[new > state["starts"][-1]]
        state["starts"] = np.concatenate([state["starts"], new])
        state["clock"] = _advance(np.concatenate([state["clock"], new]), times, state["d"])

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        for batch in batches:
            if not len(batch):
                continue
            _, opens = _numbered(batch)
            key, d, done = list(zip(batch["domain"], batch["slice"])), batch["d"].to_numpy(), []
            start, last = 0, int(opens[-1])
            if state is not None and key[0] == state["key"]:
                start = int(opens[1]) if len(opens) > 1 else len(batch)
                follow(state, batch[:start])
            if start < len(batch):  # another slice begins
                if state is not None:
                    done.append(finish(state))
                if start < last:
                    done.append(_whole_exits(batch[start:last], slice_delays)[EXITS])
                state = begin(key[last], int(d[last]))
                follow(state, batch[last:])
            if done:
                yield pd.concat(done, ignore_index=True)
        if state is not None:
            yield finish(state)

    return exits


def _slice_clocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each domain's slices in order and note the clock every slice starts with."""
    current, clock, after, taken = None, NO_FETCH, NO_FETCH, False
    for batch in batches:
        out = []
        for domain, part, d, first, last in zip(*(batch[c].tolist() for c in EXITS)):
            if (domain, part) != current:
                clock = after if current is not None and domain == current[0] else NO_FETCH
                current, after, taken = (domain, part), clock, False
                out.append((domain, part, d, clock))
            if not taken and first != NO_FETCH and first >= clock + d:
                taken, after = True, last
        yield pd.DataFrame(out, columns=["domain", "slice", "d", "clock"])


def decide(unmarked: int = NO_FETCH):
    """Each slice opens with its clock row; the requests follow in time order. ``unmarked``: the clock of slices without.

    The slices of a batch are decided together: their chains of fetches are followed step by step, all at once.
    """

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, clock = None, unmarked
        for batch in batches:
            if not len(batch):
                continue
            t, d, jobs = (batch[c].to_numpy() for c in ("t", "d", "job_id"))
            is_clock, moves = (batch[c].to_numpy().astype(bool) for c in ("is_clock", "moves"))
            group, opens = _numbered(batch)
            clocks = np.full(len(opens), unmarked, dtype=np.int64)
            if (batch["domain"].iat[0], batch["slice"].iat[0]) == current:
                clocks[0] = clock
            clocks = np.where(is_clock[opens], t[opens], clocks)
            movers = np.flatnonzero(moves & ~is_clock)
            times, n = t[movers], len(movers)
            after = _first_at(times, group[movers], times + d[movers], group[movers])
            at, fetched = _first_at(times, group[movers], clocks + d[opens], np.arange(len(opens))), np.zeros(n, dtype=bool)
            while len(at := at[at < n]):
                fetched[at] = True
                at = after[at]
            # the place after the last fetch before each row; the slice's clock counts where that is in an earlier slice
            places = movers[fetched] + 1
            last = np.zeros(len(batch) + 1, dtype=np.int64)
            last[places] = places
            last = np.maximum.accumulate(last)
            since = np.where(last[:-1] > opens[group], t[last[:-1] - 1], clocks[group])
            polite = t >= since + d
            current = (batch["domain"].iat[-1], batch["slice"].iat[-1])
            clock = int(t[last[-1] - 1] if last[-1] > opens[-1] else clocks[-1])
            yield pd.DataFrame({"job_id": jobs[~is_clock], "polite": polite[~is_clock]})

    return verdicts


def politeness_gate(requests: DataFrame, slice_delays: int = SLICE_DELAYS) -> DataFrame:
    """(domain, job_id, requested_at, delay[, fetched]) to (job_id, polite).

    ``delay`` is constant per domain. ``fetched`` is false for requests that got no
    response; they may be allowed but leave the clock alone. Equal times go by job_id.
    """
    rows = sliced(requests, slice_delays)
    narrow = rows.select("domain", "slice", "t", "d", "moves").repartition("domain", "slice")
    exits = narrow.sortWithinPartitions("domain", "slice", "t").mapInPandas(
        _slice_exits(slice_delays), "domain string, slice long, d long, first_fetch long, last_fetch long"
    )
    clocks = (
        exits.repartition("domain").sortWithinPartitions("domain", "slice", "first_fetch")
        .mapInPandas(_slice_clocks, "domain string, slice long, d long, clock long")
    )
    marks = clocks.select(
        "domain", "slice", F.lit(0).cast("long").alias("job_id"),
        F.col("clock").alias("t"), "d", F.lit(False).alias("moves"), F.lit(True).alias("is_clock"),
    )
    # Step 3 opens every slice with its clock row.
    both = rows.withColumn("is_clock", F.lit(False)).unionByName(marks)
    return (
        both.repartition("domain", "slice")
        .sortWithinPartitions("domain", "slice", F.desc("is_clock"), "t", "job_id")
        .mapInPandas(decide(), "job_id long, polite boolean")
    )
