"""Lines for published files, and upserts into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(c: Column) -> Column:
    """Quoted if it holds a quote, comma or line end, or begins or ends with a space; null is empty."""
    c = c.cast("string")
    return F.when(c.rlike(r'[",\r\n]|^ | $'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def csv_line(*columns: str) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """(value): a line for each row of all columns; write.text(..., lineSep='\\r\\n') ends them as RFC 4180 says."""
    return df.select(csv_line(*df.columns).alias("value"))


def upserted(stored: DataFrame, arriving: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What a table holds after arrivals: of rows with one key, nulls equal, the one last by order. One aggregation over
    both, no join; the caller writes it as a new table and then points readers to that."""
    both = stored.unionByName(arriving)
    rest = [c for c in both.columns if c not in keys]
    last = F.max_by(F.struct(*rest), order).alias("last")
    return both.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"last.`{c}`").alias(c) for c in both.columns])
