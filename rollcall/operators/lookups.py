"""Lookups in tiers, unique matches, and rows beside their best partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import best_of


def unique_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) where the keys name exactly one value; ambiguous keys are left out."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("matches")).filter("matches = 1").drop("matches")


def cascade(rows: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """rows with value and tier, the name of the first of (name, table of keys and value, keys) that has a match: one
    left join a tier, null keys match nothing. Tables have one row for each key."""
    found, named = [], []
    for k, (name, other, keys) in enumerate(tiers):
        mine = f"{value}_{k}"
        rows = rows.join(other.select(*keys, F.col(value).alias(mine)), keys, "left")
        found.append(F.col(mine))
        named.append(F.when(F.col(mine).isNotNull(), name))
    out = rows.withColumn(value, F.coalesce(*found)).withColumn("tier", F.coalesce(*named, F.lit("none")))
    return out.drop(*[f"{value}_{k}" for k in range(len(tiers))])


def with_best(left: DataFrame, right: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """left with columns of its best partner by key, null where it has none: a lateral join with limit 1."""
    return left.join(best_of(right, [key], order).select(key, *columns), key, "left")


def single_name(rows: DataFrame, candidates: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """rows with the value of the only candidate of their key, or of the only one with their name; else null."""
    alone = unique_keys(candidates, [key], value).withColumnRenamed(value, "alone")
    by_name = unique_keys(candidates, [key, name], value).withColumnRenamed(value, "named")
    out = rows.join(alone, key, "left").join(by_name, [key, name], "left")
    return out.withColumn(value, F.coalesce("alone", "named")).drop("alone", "named")
