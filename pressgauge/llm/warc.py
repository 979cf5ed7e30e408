"""Merkle fixity audit of replicas of WARC files.

Records lie in files at their offsets. A leaf is the SHA-256 of a record's offset, length and bytes. The leaves that begin
in one range of RANGE bytes, in order of offset, give a node; FAN neighbouring ranges the next level's, up to one root for
each file. Two replicas are compared root by root, and only the children of differing (or missing) nodes are looked at,
level by level, down to the records.

A node has at most FAN children, or the records that begin in RANGE bytes, so no group grows with the data. Records with
null bytes hash as such (and differ from empty ones); records at one offset are told apart by the order of their digests.
An empty replica lacks every file; two empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import stored

FAN = 64
RANGE = 1 << 16


def records(pages: DataFrame, record_id: str, url: str, body: str, per_file: int = 256) -> DataFrame:
    """WARC/1.1 resource records of ``pages``: file, offset, length, record_id, url, content.

    Files hold about ``per_file`` records: which one follows from a digest of id and url, the order in it from the id.
    Offsets are running sums within a file, whose size is bounded.
    """
    files = max(1, -(-pages.count() // per_file))
    payload = F.coalesce(F.col(body), F.lit(""))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.col(url), F.lit(""))),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), F.coalesce(F.col(record_id).cast("string"), F.lit("")), F.lit(">")),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")), F.lit(""), F.lit(""),
    )
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(record_id).cast("string"), url)), 1, 8), 16, 10).cast("long")
    rows = pages.select(
        F.col(record_id).alias("record_id"), F.col(url).alias("url"), F.pmod(draw, F.lit(files)).alias("file"),
        F.concat(head, payload, F.lit("\r\n\r\n")).cast("binary").alias("content"),
    ).withColumn("length", F.octet_length("content").cast("long"))
    order = Window.partitionBy("file").orderBy("record_id", F.xxhash64("content")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length")).select("file", "offset", "length", "record_id", "url", "content")


def leaves(replica: DataFrame) -> DataFrame:
    """One row for each record: file, n (its offset), copy (of those at one offset), end, record_id, digest."""
    digest = F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce(F.sha2("content", 256), F.lit("null"))), 256)
    rows = replica.select("file", F.col("offset").alias("n"), (F.col("offset") + F.col("length")).alias("end"), "record_id", digest.alias("digest"))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("file", "n").orderBy("digest")))


def _above(n: Column, level: int) -> Column:
    return F.floor(n / (FAN if level else RANGE)).cast("long")


def tree(replica: DataFrame, name: str) -> list[DataFrame]:
    """Levels of the trees, leaves first and roots last; each is a table in the shared folder."""
    levels = [stored(leaves(replica), f"{name}-leaves")]
    widest, level = levels[0].agg(F.max("n")).first()[0] or 0, 0
    while level == 0 or widest:
        widest //= FAN if level else RANGE
        parts = F.sort_array(F.collect_list(F.struct("n", "copy", "end", "digest")))
        nodes = levels[-1].groupBy("file", _above(F.col("n"), level).alias("parent")).agg(parts.alias("parts"))
        digest = F.sha2(F.concat_ws(",", F.transform("parts", lambda p: F.concat_ws("|", p["n"].cast("string"), p["digest"]))), 256)
        level += 1
        nodes = nodes.select("file", F.col("parent").alias("n"), F.lit(1).alias("copy"), F.array_max(F.transform("parts", lambda p: p["end"])).alias("end"), digest.alias("digest"))
        levels.append(stored(nodes, f"{name}-{level}"))
    return levels


def audit(primary: list[DataFrame], copy: list[DataFrame]) -> DataFrame:
    """Records that differ: file, kind (changed, missing, added), and offset, length and id on either side."""
    depth, suspects, unlike = max(len(primary), len(copy)), None, None
    for level in range(depth - 1, -1, -1):
        sides = []
        for levels in (primary, copy):
            # a tree that is less deep has nothing at this level: the other's nodes there all differ
            rows = levels[level] if level < len(levels) else levels[-1].where("false")
            if suspects is not None:  # only children of nodes that differ
                parent = F.lit(0) if level == len(levels) - 1 else _above(F.col("n"), level)
                rows = rows.withColumn("parent", parent.cast("long")).join(suspects, ["file", "parent"], "left_semi").drop("parent")
            sides.append(rows)
        a, b = sides[0].alias("a"), sides[1].alias("b")
        same = (F.col("a.file") == F.col("b.file")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.copy") == F.col("b.copy"))
        unlike = a.join(b, same, "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        if level:
            suspects = stored(unlike.select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.n", "b.n").alias("parent")).distinct(), f"suspects-{level}")
    kind = F.when(F.col("b.n").isNull(), "missing").when(F.col("a.n").isNull(), "added").otherwise("changed")
    left = [F.col("a.n").alias("offset"), (F.col("a.end") - F.col("a.n")).alias("length"), F.col("a.record_id").alias("record_id")]
    right = [F.col("b.n").alias("copy_offset"), (F.col("b.end") - F.col("b.n")).alias("copy_length"), F.col("b.record_id").alias("copy_record_id")]
    return unlike.select(F.coalesce("a.file", "b.file").alias("file"), kind.alias("kind"), *left, *right)
