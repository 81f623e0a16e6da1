"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, key: str, value: str, share: float, blocks: int = 1024) -> DataFrame:
    """(key, n, total, mean, p95, most) with the value at rank ceil(share * n) of each group, exactly.

    Equal values are counted first. Each group is cut into equal ranges of values (blocks); ranges' counts, at most
    `blocks` rows a group, say in which one the rank lies, and only that range is ranked row by row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("times"))
    exact = F.sum((F.col(value).cast("decimal(18,2)") * F.col("times"))).cast("double")
    whole = counted.groupBy(key).agg(F.sum("times").alias("n"), exact.alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    wide = F.col("most") - F.col("least")
    block = F.when(wide > 0, F.floor((F.col(value) - F.col("least")) / wide * (blocks - 1))).otherwise(0)
    own = counted.join(whole, key).withColumn("block", block.cast("long"))
    per = own.groupBy(key, "block").agg(F.sum("times").alias("held"), F.first("n").alias("n"))
    upto = Window.partitionBy(key).orderBy("block")
    per = per.withColumn("before", F.sum("held").over(upto) - F.col("held")).withColumn("rank", F.ceil(F.lit(share) * F.col("n")))
    hit = per.filter((F.col("before") < F.col("rank")) & (F.col("before") + F.col("held") >= F.col("rank"))).select(key, "block", "before", "rank")
    inside = own.join(hit, [key, "block"])
    seen = F.sum("times").over(Window.partitionBy(key).orderBy(value)) + F.col("before")
    at = inside.withColumn("seen", seen).filter("seen >= rank").groupBy(key).agg(F.min(value).alias("p95"))
    return whole.join(at, key).select(key, "n", "total", (F.col("total") / F.col("n")).alias("mean"), "p95", "most")
