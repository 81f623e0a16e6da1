"""One row for each key: best of a group, merge folds over arrivals, and keep-first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """The name, longer by underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def best_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key, as a lateral join with a limit would give them."""
    rank = unused(df, "rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank)


def first_known(c: str, order: Column) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), order))


def last_known(c: str, order: Column) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), order))


def merged(
    df: DataFrame,
    keys: list[str],
    order: str,
    first: Sequence[str] = (),
    last: Sequence[str] = (),
    low: Sequence[str] = (),
    high: Sequence[str] = (),
    longest: Sequence[str] = (),
    frozen: Sequence[str] = (),
    latest: Sequence[str] = (),
    ever: Sequence[str] = (),
) -> DataFrame:
    """Upserts in arrival order as one aggregation, null keys equal. By column: the first or last known value (first,
    last), the least or greatest (low, high), the longest, the earliest of these on ties (longest), the first
    arrival's value, null or not (frozen), the last arrival's (latest), and whether it ever held (ever)."""
    o = F.col(order)
    aggs = [first_known(c, o).alias(c) for c in first]
    aggs += [last_known(c, o).alias(c) for c in last]
    aggs += [F.min(c).alias(c if c not in high else f"first_{c}") for c in low]
    aggs += [F.max(c).alias(c if c not in low else f"last_{c}") for c in high]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -o))).alias(c) for c in longest]
    aggs += [F.min_by(c, o).alias(c) for c in frozen]
    aggs += [F.max_by(c, o).alias(c) for c in latest]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ever]
    return df.groupBy(*keys).agg(*aggs)


def address_class(kind: str, order: str) -> Column:
    """The class of an address over its arrivals: 'published' once it ever was, else that of the first arrival."""
    return F.when(F.bool_or(F.col(kind) == "published"), "published").otherwise(F.min_by(kind, order))


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that arrived with more than one combination of values: what an insert-once sink would refuse."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("versions")).filter("versions > 1")


def versions(df: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """(key, content, version): contents of a document numbered by first appearance; one that comes back keeps its
    number, and a null content counts as one of its own at each arrival."""
    own = df.withColumn(content, F.coalesce(F.col(content).cast("string"), F.concat(F.lit("unhashed:"), F.col(order).cast("string"))))
    seen = unused(df, "seen")
    first = own.groupBy(key, content).agg(F.min(order).alias(seen))
    return first.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(seen, content))).drop(seen)


def folded_records(df: DataFrame, key: str, soft: str, order: str, confidence: str, fields: list[str], lists: list[str]) -> DataFrame:
    """Records of one page that mean the same person, folded by key and then by soft key. Of two records the one with
    the higher confidence, the earlier on ties, gives its fields; nulls are filled from the other; lists are united,
    the surer one's first. A record's place is that of its first arrival. The groups are records of one page and key."""

    def step(a: Column, b: Column) -> Column:
        sure = a[confidence] >= b[confidence]
        own = [F.when(sure, F.coalesce(a[c], b[c])).otherwise(F.coalesce(b[c], a[c])).alias(c) for c in fields]
        joined = [F.when(sure, F.array_union(a[c], b[c])).otherwise(F.array_union(b[c], a[c])).alias(c) for c in lists]
        kept = [F.when(sure, a[c]).otherwise(b[c]).alias(c) for c in (key, soft)]
        return F.struct(a[order].alias(order), F.greatest(a[confidence], b[confidence]).alias(confidence), *kept, *own, *joined)

    def fold(rows: DataFrame, by: str) -> DataFrame:
        whole = F.struct(order, confidence, key, soft, *fields, *lists)
        group = rows.groupBy(F.col(by).alias("group")).agg(F.array_sort(F.collect_list(whole)).alias("own"))
        return group.select(F.aggregate(F.slice("own", 2, 1 << 30), F.col("own")[0], step).alias("own")).select("own.*")

    return fold(fold(df, key), soft)
