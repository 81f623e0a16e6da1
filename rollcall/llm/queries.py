"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, dialogue, lm, materialise, mixing, neardup, packing, rules, secret_scan, warc, webp, whitening
from .common import read

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_back(warc.written(read(spark, sf_dir, "pages")))
    kind = F.when(F.col("record_type") == "revisit", "revisit").otherwise("response")  # whatever the URL's scheme
    return rows.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(read(spark, sf_dir, "documents"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots, _ = materialise.materialised(read(spark, sf_dir, "documents"), vocabulary())
    return materialise.read_back(slots)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.reported(read(spark, sf_dir, "documents"))


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.stored(read(spark, sf_dir, "documents"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return crf.scored(docs, crf.train(docs, read(spark, sf_dir, "labels")))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(read(spark, sf_dir, "embeddings"))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(read(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_warc, op3_rules, op4_packing, op5_near_dedup, op6_training_order, op7_secrets, op8_webp, op9_line_crf, op10_lm, op11_whitening, op12_dialogue, op13_mixing, pipeline)
}
#: SHA-1 in base 32 from its hexadecimal digits h: five bits a letter.
_HEX = "strpos('0123456789abcdef', substr(h, {0}, 1)) - 1"
_BASE32 = f"""array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
CAST(1 + (((({_HEX.format("5 * i // 4 + 1")}) * 16 + {_HEX.format("5 * i // 4 + 2")}) >> (3 - 5 * i % 4)) & 31) AS BIGINT), 1)), '')"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "op13_mixing": rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST) AS k FROM s),
f AS (SELECT k, source_size, w, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighs FROM o),
c AS (SELECT k, CAST(remains AS DOUBLE) / CAST(weighs AS DOUBLE) AS level FROM f WHERE w * remains <= 3 * source_size * weighs ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k < c.k THEN 3.0::DOUBLE * o.source_size ELSE CAST(o.w AS DOUBLE) * c.level END AS target,
CAST('0x' || substr(md5(CASE WHEN o.source IS NULL THEN 'mix' ELSE 'mix:' || o.source END), 1, 6) AS BIGINT) AS start FROM o, c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size * 16777216 + 0.5), 3 * 16777216) AS BIGINT) ELSE 0 END AS rate FROM t),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id NULLS FIRST) AS place FROM d)
SELECT doc_id, size, source_size, target, CAST(size * (((place * rate + start) >> 24) - (((place - 1) * rate + start) >> 24)) AS BIGINT) AS taken FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source""",
    "op2_warc": f"""SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
    "op5_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT e.b, r.other FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = d.doc_id AS kept FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
}
