"""Checkpointed, incremental ingestion of files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType | str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, exactly once over restarts."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_windows(stream: DataFrame, time: str, keys: list[str], target: str, checkpoint: str, late: str = "3650 days") -> StreamingQuery:
    """Counts, first and last time by hour and keys of everything there is now: each trigger appends the windows that
    it changed, of which the last is the widest. Rows later than `late` are left out, so that state stays bounded."""
    hour = F.date_trunc("hour", time).alias("hour")
    own = stream.withWatermark(time, late).groupBy(hour, *keys).agg(F.count("*").alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")  # the same place if a batch runs again

    return own.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
