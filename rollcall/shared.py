"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is not set, a session on one machine gets a folder of its own,
    and any other one a ValueError."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rollcall-')}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rollcall/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at a path: plans stay short, lost executors lose nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """df as a table at a path, and its number of rows, which the writing job counts."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["n"])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each longer by underscores until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dealt(df: DataFrame, column: str) -> DataFrame:
    """df with all rows of one value in one partition. A repartition by the column itself is dropped where the plan below
    is already dealt by it, as behind a join, and what is left may then be read map by map once that join is broadcast;
    a hash that no join uses stays."""
    return df.repartition(F.xxhash64(F.lit("dealt"), F.col(column)))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as the session runs at once, for work that is dear by the row: a small file of many narrow rows
    is otherwise read, and worked on, by one task. With columns, rows that are near by their order stay together."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, *by) if by else df.repartition(n)
