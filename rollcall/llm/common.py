"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder, unused
from ..shipping import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir)."""
    return folder(spark, name)


def kept(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text binary): whole texts as UTF-8, null as empty; other columns go."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[tuple]:
    """Rows as tuples, with few of a batch as Python values at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, at_once).columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


BATCH_ROWS = 256  # rows of whole texts that a task exchanges with Python at a time


def _prepared(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: By operator (module): what lets go of the tables that it keeps in a Python worker between tasks.
LETS_GO: dict[str, Callable[[], None]] = {}
_last: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def task_of(module: str, batches: Iterator) -> Iterator:
    """What a task of an operator gives. Workers outlive stages, so tables of others go before it begins, if the worker's
    last task was another operator's, and when it is done the system gets back what it has freed."""
    if _last[:1] != [module]:
        _last[:] = [module]
        for let_go in LETS_GO.values():
            let_go()
    yield from batches
    del batches
    if _trim is not None:
        _trim(0)


def map_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with function(iterator of row tuples) -> iterator of row tuples; schema: 'name type, ...'."""
    _prepared(df.sparkSession)
    arrow, module = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in schema.split(", "))]), function.__module__

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        return task_of(module, batches_of(function(rows_of(batches)), arrow))

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with function(iterator of record batches) -> iterator of lists of columns."""
    _prepared(df.sparkSession)
    arrow, module = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in schema.split(", "))]), function.__module__

    def made(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        return task_of(module, made(batches))

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with function(iterator of row tuples) -> iterator of lists of columns, each a list or an array."""

    def of_batches(batches):
        return function(rows_of(batches))

    of_batches.__module__ = function.__module__
    return map_batches(df, of_batches, schema)


def keep_rows(docs: DataFrame, wanted, columns: list[str], more: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of docs, all columns as they are, for which wanted(*values) holds; values are UTF-8, null as empty, and
    those of the columns in `more` as they are."""
    _prepared(docs.sparkSession)
    module = wanted.__module__

    def left(batches):
        for batch in batches:
            parts = [pa.array(batch.column(c)).cast(pa.string()).cast(pa.binary()) for c in columns]
            others = [batch.column(c) for c in more]
            mask = [bool(wanted(*(x.as_py() or b"" for x in row[: len(columns)]), *(x.as_py() for x in row[len(columns) :]))) for row in zip(*parts, *others, strict=True)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        return task_of(module, left(batches))

    return docs.mapInArrow(run, docs.schema)
