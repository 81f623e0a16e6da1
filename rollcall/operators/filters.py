"""Optional filters, ranks, choices among rules, and numbering in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import placed


def chosen(df: DataFrame, search: tuple[str, list[str]] | None = None, after: tuple[str, object] | None = None, among: dict[str, list] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """Rows that meet all filters given: a literal text in the joined columns, whatever the case; a key above a cursor;
    columns among values, where an empty list is no filter; a time not after a snapshot."""
    if search and search[0].strip():
        df = df.filter(F.contains(F.lower(F.concat_ws(" ", *search[1])), F.lit(search[0].strip().lower())))
    if after:
        df = df.filter(F.col(after[0]) > F.lit(after[1]))
    for column, values in (among or {}).items():
        if values:
            df = df.filter(F.col(column).isin(values))
    if until:
        df = df.filter(F.col(until[0]) <= F.lit(until[1]))
    return df


def within(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among those of another table."""
    return df.join(keys.select(key), key, "left_semi")


def available(df: DataFrame, column: str, state: str = "all") -> DataFrame:
    """all rows, or those where a column is published, or missing."""
    if state not in ("all", "published", "missing"):
        raise ValueError(f"no such state: {state}")
    return df if state == "all" else df.filter(F.col(column).isNotNull() if state == "published" else F.col(column).isNull())


def between(name: str, value: int, least: int, most: int) -> int:
    """The value, if it lies within bounds; else ValueError, before any data are read."""
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")
    return value


def ranked(column: str, values: list[str]) -> Column:
    """The place of a column's value in a list; all others share the place after it."""
    out = F.when(F.lit(False), 0)
    for k, v in enumerate(values):
        out = out.when(F.col(column) == v, k)
    return out.otherwise(len(values))


def best_registered(adapters: list[tuple[str, float, Column]]) -> Column:
    """The name of the adapter (name, threshold, score) with the highest score that reaches its own threshold, the
    first one on ties; 'none' if there is none."""
    own = [F.when(score >= need, F.struct(score.cast("double").alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name"))) for k, (name, need, score) in enumerate(adapters)]
    return F.coalesce(F.array_max(F.array_compact(F.array(*own)))["name"], F.lit("none"))


def robots_allow(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether rules (allow or disallow, pattern with * and $) let a path be read: the longest that matches decides,
    allow on ties, and no rule allows."""

    def pattern(p: str) -> str:
        whole = p.endswith("$")
        return "^" + ".*".join(rf"\Q{x}\E" for x in p.removesuffix("$").split("*")) + ("$" if whole else "")

    hits = [F.when(path.rlike(pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(kind == "allow").alias("ok"))) for kind, p in rules if p]
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["ok"], F.lit(True))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with its rows' places, from 0, in the order of a key of any type that can be sorted."""
    return placed(df, [F.col(key)], name).withColumn(name, F.col(name) - 1)
