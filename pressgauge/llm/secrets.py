"""Secret scans: fixed patterns, and strings that a character Markov model of random strings explains better.

Base kinds are leftmost, non-overlapping matches of their own pattern: ``assign`` (a keyword, a sign and a value of 12 or
more characters), ``access`` (AKIA keys of 18 or more) and ``hex`` (16 or more digits). The method adds ``markov`` spans:
runs of CANDIDATE characters whose log-likelihood under the model of random strings exceeds that under the model of
ordinary identifiers by ``margin`` per transition. Both models count transitions between characters, add one half to each
count, and are trained from labelled samples. A run that a base span covers exactly, or that is its value, is not added.

Everything is column expressions on the text's own row: nothing is shuffled. Positions are code points, ends exclusive.

Null texts count as empty: no spans. Very long texts stay whole; positions of n matches come from block sums, so the cost
does not grow with the square of n. Repeated rows get equal spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .winnow import let

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so this drops exactly the short ones
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
CODES = 128
BLOCK = 512


def running(lengths: Column) -> Column:
    """For each element the sum of those before it, by block sums."""

    def add(a: Column, x: Column) -> Column:
        return a + x

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), add)

    def prefixes(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return F.slice(grown, 1, F.size(xs))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        return let(blocks, lambda bs: let(prefixes(F.transform(bs, total), F.lit(0).cast("long")), lambda starts: F.flatten(F.zip_with(bs, starts, prefixes))))

    return F.when(F.size(lengths) > 0, let(lengths, whole)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, inner>> of all leftmost non-overlapping matches; ``inner`` is the group's text."""

    def located(x: Column) -> Column:
        gaps, found, inner = x["gaps"], x["found"], x["inner"]
        # what lies between matches alternates with them: each start is all gaps up to here and all matches before
        steps = F.transform(found, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("long"))
        return let(running(steps), lambda before: F.transform(
            found, lambda m, i: F.struct(
                (F.get(before, i) + F.char_length(F.get(gaps, i))).alias("start"),
                (F.get(before, i) + F.char_length(F.get(gaps, i)) + F.char_length(m)).alias("end"),
                F.get(inner, i).alias("inner"),
            )
        ))

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("inner"),
    )
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, located)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,inner:string>>"))


def transitions(samples: DataFrame, text: str = "text", label: str = "label") -> list[float]:
    """Log-likelihood ratio (label 1 against 0) of each pair of ASCII characters, CODES * CODES of them."""
    chars = F.transform(F.split(F.col(text), ""), lambda c: F.ascii(c))
    pairs = F.transform(F.sequence(F.lit(1), F.size("chars") - 1), lambda i: F.element_at("chars", i) * CODES + F.element_at("chars", i + 1))
    rows = (
        samples.where(F.char_length(text) > 1).select(F.col(label).alias("label"), chars.alias("chars"))
        .select("label", F.explode(pairs).alias("pair")).where(F.col("pair").between(0, CODES * CODES - 1))
        .groupBy("label", "pair").count().collect()  # at most 2 * CODES * CODES rows
    )
    counts = {0: [0.0] * CODES * CODES, 1: [0.0] * CODES * CODES}
    for r in rows:
        counts[r["label"]][r["pair"]] += r["count"]
    logs = {}
    for k, c in counts.items():
        totals = [sum(c[a * CODES : (a + 1) * CODES]) for a in range(CODES)]
        logs[k] = [math.log((c[i] + 0.5) / (totals[i // CODES] + 0.5 * CODES)) for i in range(CODES * CODES)]
    return [a - b for a, b in zip(logs[1], logs[0])]


def samples_of(docs: DataFrame, text: str = "text", key: str = "doc_id", max_texts: int = 4000) -> DataFrame:
    """Labelled samples from about ``max_texts`` texts each, chosen by a hash of the key.

    Random strings are the values of base matches; ordinary identifiers are runs of eight or more letters, and such runs
    joined by an underscore, in texts without a base match.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    any_base = F.rlike(body, F.lit("|".join((ASSIGN, ACCESS, HEX))))
    rows = docs.select(body.alias("text"), any_base.alias("marked"), F.xxhash64(F.col(key).cast("string")).alias("draw"))
    total = {r["marked"]: r["count"] for r in rows.groupBy("marked").count().collect()}
    value = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit(f"({ACCESS}|{HEX})"), F.lit(1)))
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Za-z]{4,}(?:_[A-Za-z]+)*)(?![A-Za-z0-9])"), F.lit(1))
    out = None
    for marked, label, found in ((True, 1, F.filter(value, lambda v: F.char_length(v) >= 12)), (False, 0, words)):
        share = min(1.0, max_texts / max(1, total.get(marked, 0)))
        part = rows.where(F.col("marked") == marked)
        if share < 1:
            part = part.where(F.col("draw") < int((share - 0.5) * 2**64))
        part = part.select(F.explode(found).alias("text"), F.lit(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def markov_score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    array = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")  # folded to one literal

    def mean(codes: Column) -> Column:
        last = F.size(codes) - 1
        total = F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0.0), lambda s, i: s + F.get(array, F.get(codes, i) * CODES + F.get(codes, i + 1)))
        return F.when(last > 0, total / last).otherwise(F.lit(0.0))

    return let(F.transform(F.split(token, ""), lambda c: F.ascii(c)), mean)


def scan(docs: DataFrame, ratios: list[float], keep: list[str], text: str = "text", margin: float = 1.2) -> DataFrame:
    """The columns ``keep`` of each text and ``found``: array<struct<start, kind, end, name>>, base and markov spans."""
    body = F.coalesce(F.col(text), F.lit(""))

    def spans(x: Column) -> Column:
        def kind(k: int, of: Column) -> Column:
            return F.transform(of, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), F.lit(KINDS[k]).alias("name")))

        def place(m: Column) -> Column:
            return F.struct(m["start"], m["end"])

        # 31 bits for the start, 31 for the length: array_except then compares numbers
        def number(start: Column, end: Column) -> Column:
            return start * (1 << 31) + (end - start)

        covered = F.concat(
            F.transform(x["assign"], lambda m: number(m["end"] - F.char_length(m["inner"]), m["end"])),
            F.transform(x["access"], lambda m: number(m["start"], m["end"])), F.transform(x["hex"], lambda m: number(m["start"], m["end"])),
        )
        likely = F.filter(x["runs"], lambda m: markov_score(m["inner"], ratios) > margin)
        new = F.array_except(F.transform(likely, lambda m: number(m["start"], m["end"])), covered)
        added = F.transform(new, lambda n: F.struct(F.shiftright(n, 31).alias("start"), (F.shiftright(n, 31) + n.bitwiseAND((1 << 31) - 1)).alias("end")))
        return F.sort_array(F.concat(kind(0, x["assign"]), kind(1, x["access"]), kind(2, x["hex"]), kind(3, added)))

    found = F.struct(
        F.filter(matches(F.col("text"), ASSIGN, 1), lambda m: F.char_length(m["inner"]) >= 12).alias("assign"),
        F.filter(matches(F.col("text"), ACCESS), lambda m: m["end"] - m["start"] >= 18).alias("access"),
        matches(F.col("text"), HEX).alias("hex"), matches(F.col("text"), CANDIDATE).alias("runs"),
    )
    kept = [F.col(c).alias(f"kept {i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, body.alias("text")).select(*[f"kept {i}" for i in range(len(keep))], let(found, spans).alias("found"))
    return rows.select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(keep)], F.col("found"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def base(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"] < 3)


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["name"] == kind)).cast("long")
