"""A corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import crf, neardup, packing, rules, secret_scan
from rollcall.llm.common import kept, read, unused
from rollcall.llm.queries import vocabulary

#: A document stays if its quality is at least this.
LEAST_QUALITY = crf.GOOD_FROM


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    (key,) = unused(docs, "kept_id")
    return docs.join(ids.select(F.col("doc_id").alias(key)).distinct(), F.col("doc_id").cast("long") == F.col(key), "left_semi")


def _one_each(docs: DataFrame) -> DataFrame:
    """One row for each id: that of the longest text, then the first by text and by the other columns as JSON, which
    columns of any type have."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(-F.length(F.coalesce("text", F.lit(""))), F.col("text"), F.to_json(F.struct(F.lit(0).alias("_"), *own)))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_first")
    return docs.groupBy(F.col("doc_id").alias("_id")).agg(first).select(*[F.col(f"_first.`{c}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, learned from labels, calls good. A null text counts as an empty one; equal rows
    are judged alike; without labels all stay; columns of any other name pass through; an empty table gives none."""
    model = crf.train(docs, read(spark, sf_dir, "labels"))
    return crf.filtered(docs, model, LEAST_QUALITY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the references of their language. A null or empty text fails
    the base rules; a null and an empty language are one; equal rows are judged alike; an empty table gives none."""
    return rules.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies; every row without an id. Rows that
    share an id are one document: that of the longest text stays, on ties the first by text and other columns. Null
    and empty texts are nobody's copies and stay; an empty table gives none."""
    decided = neardup.linked(docs)
    return _one_each(_only(docs.filter("doc_id is not null"), decided.filter("kept"))).union(docs.filter("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked. Null and empty texts, and texts without secrets, stay as they are; rows without
    an id and repeated rows are masked each for itself; an empty table gives none."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens. A null or empty text is the end id alone; rows without an id and
    repeated rows are packed each for itself; an empty table gives none."""
    return packing.packed(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Learned models, near duplicates and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
