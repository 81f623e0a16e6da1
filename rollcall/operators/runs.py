"""Runs along an order: consecutive failures, budgets, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import unused


def consecutive(df: DataFrame, keys: list[str], order: list[str], bad: Column, name: str = "streak") -> DataFrame:
    """How many bad rows stand in a row up to each row; a good one sets the count to 0."""
    wrong = unused(df, "wrong")
    run = unused(df, "run")
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn(wrong, F.coalesce(bad, F.lit(False)).cast("int")).withColumn(run, F.sum(1 - F.col(wrong)).over(w))
    own = Window.partitionBy(*keys, run).orderBy(*order)
    return marked.withColumn(name, F.sum(wrong).over(own)).drop(wrong, run)


def within_budget(df: DataFrame, keys: list[str], order: list[str], budget: int) -> DataFrame:
    """The first `budget` rows of each key."""
    rank = unused(df, "rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= budget).drop(rank)


def within_spending(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows whose cost and that of all before them stay within a budget."""
    spent = unused(df, "spent")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(spent, F.sum(cost).over(w)).filter(F.col(spent) <= budget).drop(spent)


def chain_breaks(df: DataFrame, keys: list[str], order: list[str], value: str, previous: str) -> DataFrame:
    """Rows whose `previous` is not the `value` of the row before them."""
    before = unused(df, "before")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(before, F.lag(value).over(w)).filter(~F.col(before).eqNullSafe(F.col(previous))).drop(before)


def first_breaks(df: DataFrame, keys: list[str], sequence: str, value: str, previous: str) -> DataFrame:
    """(keys, sequence, reason) of the first row of each chain that breaks it: its number is not above the one before
    it, or its `previous` is not that row's `value`."""
    w = Window.partitionBy(*keys).orderBy(sequence, value)
    number, own = F.lag(sequence).over(w), F.lag(value).over(w)
    reason = F.when(number >= F.col(sequence), "sequence").when(~own.eqNullSafe(F.col(previous)), "link")
    marked = df.select(*keys, sequence, reason.alias("reason")).filter("reason is not null")
    return marked.groupBy(*keys).agg(F.min(F.struct(sequence, "reason")).alias("first")).select(*keys, f"first.{sequence}", "first.reason")
