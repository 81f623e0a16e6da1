"""Delimited files, with stated schemas or all as text; organisations imported by a column mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import collapse_whitespace

BOM = "﻿"


def _without_blank_rows(df: DataFrame) -> DataFrame:
    blank = reduce(lambda a, b: a & b, (F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == "" for c in df.columns))
    return df.filter(~blank)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", strict: bool = False) -> DataFrame:
    """RFC 4180 records (quoted newlines, doubled quotes); blank records go; strict: malformed ones raise."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode=mode)
    return _without_blank_rows(df)


def read_strings(spark: SparkSession, path: str, sep: str = ",", strict: bool = False, verified: bool = True) -> DataFrame:
    """All columns as text, named by the header without a byte order mark; blank records go. A source that no human
    has verified is not read at all; strict: files with a quote that does not end raise ValueError before they are."""
    if not verified:
        raise ValueError(f"{path} has not been verified")
    if strict:
        quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
        odd = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(quotes.alias("n")).filter("n % 2 = 1").limit(1).collect()
        if odd:
            raise ValueError(f"{odd[0].file} has a quote that does not end")
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE")
    return _without_blank_rows(df.toDF(*[c.removeprefix(BOM) for c in df.columns]))


def objects(df: DataFrame) -> DataFrame:
    """Names and cells with white space collapsed; missing cells are empty."""
    return df.select(*[F.coalesce(collapse_whitespace(F.col(f"`{c}`")), F.lit("")).alias(" ".join(c.split())) for c in df.columns])


def imported(rows: DataFrame, mapping: dict[str, str], required: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(organisations, rejects): columns by mapping (target -> source), rows without a required value rejected with the
    reason, of rows with one id, or without one of one type and name, the first by order kept and the others rejected."""
    own = rows.select(F.col(order).alias("row"), *[F.nullif(F.trim(F.col(s)), F.lit("")).alias(t) for t, s in mapping.items()])
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required])
    key = F.coalesce(F.concat(F.lit("id:"), F.lower("id")), F.concat_ws("|", F.lit("name"), F.lower("type"), F.lower("name")))
    good = own.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("row"))
    seen = good.filter("reason is null").withColumn("dedupe_key", key).withColumn("nth", nth)
    rejects = good.filter("reason is not null").select("row", "reason").union(seen.filter("nth > 1").select("row", F.lit("duplicate")))
    return seen.filter("nth = 1").drop("reason", "dedupe_key", "nth"), rejects
