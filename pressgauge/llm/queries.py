"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare
from . import clustering, codes, decontaminate, jaccard, language, licences, lines, mixing, packing, quality, secrets, warc, winnow
from .frames import stored, table


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the texts that the labels call good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every text under a model of the trusted ones, and whether its language's threshold rejects it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.trusted_texts(docs, trusted(spark, sf_dir)), least=1)
    return quality.judge(quality.perplexities(docs, model, ["doc_id", "lang"], spend=True), trusted(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every text, by the contract's rule of one hit word in twenty."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    x = F.col(name)
    return found.select(
        "doc_id", x["n_words"].alias("n_words"), decontaminate.hit_words(x).alias("n_hit"),
        F.size(x["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(x["items"]), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(x).alias("contaminated"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from those whose crc32 of the id leaves another remainder than 2 by 4."""
    prepare(spark)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = language.fit(docs.where("NOT held_out AND doc_id IS NOT NULL"), F.col("text"), F.col("lang"), F.col("doc_id"))
    return language.predict(docs, model, ["doc_id", "held_out"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every text and the strings that look random, all with their places."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.transitions(secrets.samples_of(docs)), ["doc_id"])
    x = F.col("found")
    return found.select(
        "doc_id", *[secrets.count_of(x, k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.written(secrets.base(x)), 256).alias("base_sha256"), secrets.written(x).alias("spans"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 1, 2, 3, repeating, takes of each text."""
    prepare(spark)
    return mixing.Mix(table(spark, sf_dir, "documents"), ["doc_id"]).taken()


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every text and of its edited text."""
    prepare(spark)
    return winnow.compared(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a whole text is, and those among its lines and paragraphs."""
    prepare(spark)
    found = licences.scan(table(spark, sf_dir, "documents"), licences.known(spark), ["doc_id"])
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("whole", "parts")])


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a damaged replica of the pages as WARC records.

    In the replica, records of urls with a fragment have a wrong first byte and those of urls with ``ref=`` are lost.
    """
    prepare(spark)
    stock = warc.records(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    broken = F.when(F.contains("url", F.lit("#")), F.concat(F.lit("X").cast("binary"), F.substring("content", 2, 1 << 30))).otherwise(F.col("content"))
    damaged = stock.where("url IS NULL OR NOT contains(url, 'ref=')").withColumn("content", broken)
    return warc.audit(warc.tree(stock, "stock"), warc.tree(damaged, "copy"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every text's set of shingles and the smallest document it is linked with."""
    prepare(spark)
    _, found, _ = jaccard.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that repeat an earlier one, exactly or nearly."""
    prepare(spark)
    cleaned = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds of eight centroids."""
    prepare(spark)
    found, centers, inertias = clustering.cluster(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", ["vec_id"])
    return clustering.labelled(found, centers, inertias)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector: eight parts, sixteen entries each, after six rounds."""
    prepare(spark)
    coded, books = codes.encode(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", ["vec_id", "label"])
    return codes.with_label_errors(coded, "label", "vec_id").drop("label").withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4,096 tokens."""
    prepare(spark)
    made = packing.pieces(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))
    return packing.kept(packing.packed(made), ["doc_id"])


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_licences": op7_licences,
    "op8_warc_audit": op8_warc_audit,
    "op9_jaccard": op9_jaccard,
    "op10_lines": op10_lines,
    "op11_clusters": op11_clusters,
    "op12_codes": op12_codes,
    "op13_packing": op13_packing,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, " + r"'[0-9a-z\x{80}-\x{10FFFF}]+')"


def _licence_lines(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    t = rf"regexp_replace({t}, '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$', chr(1), 'g')"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\n\x01]+', ' ', 'g')"
    t = f"(' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' ')"
    for spelling, one in licences.SAME:
        t = f"replace({t}, ' {spelling} ', ' {one} ')"
    return f"list_filter(string_split({t}, chr(10)), lambda x: NOT contains(x, chr(1)))"


_KNOWN = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licences.KNOWN)
_DIGEST = "sha256(trim(regexp_replace({}, ' +', ' ', 'g')))"

ORACLES = {
    "op7_licences": f"""
        WITH known AS (
            SELECT DISTINCT {_DIGEST.format(f"array_to_string({_licence_lines('text')}, ' ')")} AS digest, licence
            FROM (VALUES {_KNOWN}) AS k(licence, text)
        ),
        docs AS (SELECT row_number() OVER () AS r, doc_id, {_licence_lines('text')} AS lines FROM documents),
        units AS (
            SELECT r, true AS whole, {_DIGEST.format("array_to_string(lines, ' ')")} AS digest FROM docs
            UNION ALL
            SELECT r, false, {_DIGEST.format('x')} FROM (SELECT r, unnest(lines) AS x FROM docs)
            UNION ALL
            SELECT r, false, {_DIGEST.format("replace(x, chr(10), ' ')")}
            FROM (SELECT r, unnest(string_split_regex(array_to_string(lines, chr(10)), '\\n\\s*\\n')) AS x FROM docs) WHERE contains(x, chr(10))
        ),
        found AS (SELECT r, whole, licence FROM units JOIN known USING (digest) WHERE digest <> sha256(''))
        SELECT doc_id, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (whole), '') AS whole,
               coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (NOT whole), '') AS parts
        FROM docs LEFT JOIN found USING (r) GROUP BY r, doc_id""",
    "op9_jaccard": f"""
        WITH RECURSIVE dw AS (
            SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + least(5, len(ws))], ' ') AS g
            FROM (SELECT *, unnest(range(len(ws) - least(5, len(ws)) + 1)) AS i FROM dw WHERE len(ws) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
            JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))
        ),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS c USING (doc_id)""",
    "op8_warc_audit": """
        WITH rows AS (
            SELECT page_id, url,
                   (CAST('0x' || substr(md5(page_id || '|' || url), 1, 8) AS BIGINT)) % (SELECT greatest(1, ceil(count(*) / 256.0)::BIGINT) FROM pages) AS file,
                   octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
                       || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html'
                       || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || repeat(chr(13) || chr(10), 2)
                       || html || repeat(chr(13) || chr(10), 2))) AS length
            FROM pages
        ),
        placed AS (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id) - length AS BIGINT) AS offset FROM rows)
        SELECT file, CASE WHEN contains(url, 'ref=') THEN 'missing' ELSE 'changed' END AS kind, "offset", length, page_id AS record_id,
               CASE WHEN NOT contains(url, 'ref=') THEN "offset" END AS copy_offset,
               CASE WHEN NOT contains(url, 'ref=') THEN length END AS copy_length,
               CASE WHEN NOT contains(url, 'ref=') THEN page_id END AS copy_record_id
        FROM placed WHERE contains(url, '#') OR contains(url, 'ref=')""",
    "op2_decontamination": f"""
        WITH dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
        bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        bg AS (
            SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 13)], ' ') AS gram
            FROM (SELECT *, unnest(range(len(ws) - least(len(ws), 13) + 1)) AS i FROM bw WHERE len(ws) > 0)
        ),
        dg AS (
            SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS gram
            FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n)
        ),
        hits AS (SELECT doc_id, item_id, dg.n, i FROM dg JOIN bg ON dg.gram = bg.gram AND dg.n = bg.n),
        words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
