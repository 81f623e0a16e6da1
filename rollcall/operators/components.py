"""Connected components of records that share keys, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import counted, folder, written


def _flat(hooks: DataFrame, home: str) -> DataFrame:
    """(comp, up) with up a root: ways to smaller components, followed by doubling their length until none gets shorter."""
    k = 0
    while True:
        after = hooks.select(F.col("comp").alias("up"), F.col("up").alias("next"))
        longer, n = counted(hooks.join(after, "up").select("comp", F.col("next").alias("up")), f"{home}-longer-{k}")
        if not n:
            return hooks
        done = hooks.join(longer, "comp", "left_anti").select("comp", "up")
        hooks, k = written(done.union(longer), f"{home}-{k}"), k + 1


def components(links: DataFrame) -> DataFrame:
    """(node, component) of (node, key): nodes that share a key are linked; component is the smallest node reachable.

    In each round a component hooks on to the smallest one that it shares a key with, ways are flattened, components
    that met become one, and keys that only one component holds are dropped. All rounds are tables; the driver sees
    counts alone. A key of any number of nodes is an aggregate: its nodes are never paired. Rows with a null node or key
    link nothing and are left out.
    """
    spark = links.sparkSession
    home = folder(spark, "components")
    links = written(links.select("node", "key").filter("node is not null and key is not null").distinct(), f"{home}/links")
    edges = links.select(F.col("node").alias("comp"), "key")
    rounds: list[DataFrame] = []
    while True:
        k = len(rounds)
        ends = edges.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key", "low")
        open_ = written(edges.join(ends, "key"), f"{home}/open-{k}")
        hooks, n = counted(open_.groupBy("comp").agg(F.min("low").alias("up")).filter("up < comp"), f"{home}/hooks-{k}")
        if not n:
            break
        hooks = _flat(hooks, f"{home}/flat-{k}")
        rounds.append(hooks)
        edges = written(open_.join(hooks, "comp", "left").select(F.coalesce("up", "comp").alias("comp"), "key").distinct(), f"{home}/edges-{k}")
    out = links.select("node", F.col("node").alias("comp")).distinct()
    for hooks in rounds:
        out = out.join(hooks, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return out.select("node", F.col("comp").alias("component"))
