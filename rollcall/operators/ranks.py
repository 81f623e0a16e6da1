"""Places and running values of rows in an order, for a whole table or within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import folder, unused, written


def _own(group: list[str]) -> list[Column]:
    return [F.col(f"`{g}`") for g in group]


def _ranged(df: DataFrame, order: list[Column], group: list[str], at: str) -> DataFrame:
    """df as a table sorted by group and order, with a number that rises along it: its upper bits name the range."""
    keys = [c.asc_nulls_first() for c in _own(group)] + order
    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), folder(df.sparkSession, "ranged"))


def _with_starts(rows: DataFrame, starts: DataFrame, group: list[str], at: str, part: str) -> DataFrame:
    """rows beside what is known of their range and group: one row for each range that a group reaches into."""
    starts = written(starts.select(*[F.col(f"`{g}`").alias(f"_of_{k}") for k, g in enumerate(group)], *[c for c in starts.columns if c not in group]), folder(rows.sparkSession, "ranged"))
    same = F.shiftright(rows[at], 33) == starts[part]
    for k, g in enumerate(group):
        same &= rows[f"`{g}`"].eqNullSafe(starts[f"_of_{k}"])
    return rows.join(starts, same)


def placed(df: DataFrame, order: list[Column], name: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """df with each row's place, from 1, in an order within its group (without one: in the table).

    Rows are sorted by ranges over all tasks and written; what each range holds of each group is counted, and a running
    sum over these counts (a row for each range that a group reaches into) says where a range begins. No group meets
    in one task. Rows that the order doesn't tell apart get places by chance, each its own. Nulls are a group. df is
    computed twice, once to find the ranges: give a written table where that is dear.
    """
    at, part, first, n, before = unused(df, "_at", "_part", "_first", "_n", "_before")
    rows = _ranged(df, order, group, at)
    ranges = rows.groupBy(*_own(group), F.shiftright(at, 33).alias(part)).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*_own(group)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*_own(group), part, first, F.coalesce(F.sum(n).over(running), F.lit(0)).alias(before))
    out = _with_starts(rows, starts, group, at, part)
    return out.select(*[rows[f"`{c}`"] for c in df.columns], (F.col(before) + rows[at] - F.col(first) + 1).alias(name))


def running_max(df: DataFrame, value: str, order: list[Column], name: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """df with the greatest value of the rows before each one in its group, null where there is none: ranges as in
    placed(), each range's own rows in a window, and the ranges before it by their greatest values."""
    at, part, high, before = unused(df, "_at", "_part", "_high", "_before")
    rows = _ranged(df, order, group, at)
    highs = rows.groupBy(*_own(group), F.shiftright(at, 33).alias(part)).agg(F.max(value).alias(high))
    running = Window.partitionBy(*_own(group)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = highs.select(*_own(group), part, F.max(high).over(running).alias(before))
    inside = Window.partitionBy(*_own(group), F.shiftright(at, 33)).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn(high, F.max(value).over(inside))
    out = _with_starts(own, starts, group, at, part)
    return out.select(*[own[f"`{c}`"] for c in df.columns], F.greatest(own[high], F.col(before)).alias(name))
