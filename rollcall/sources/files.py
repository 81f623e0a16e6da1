"""Numbered lines, JSON, ZIP members and workbooks as tables; text artifacts with checksums."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import folder, written
from ..shipping import ship


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line, plain or gzip; lines that don't parse come back in _corrupt if the schema names it."""
    return spark.read.json(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one array of objects."""
    return spark.read.json(path, schema=schema, multiLine=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number from 1 in each file, plain or gzip. Blocks of a file are counted
    first, so that no task reads a whole file to number it."""
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = own.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("before", before).drop("n")
    return own.join(placed, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def inlined(column: Column, schema: str) -> Column:
    """Rows of a JSON array in a column, for select(): one struct each."""
    return F.inline(F.from_json(column, f"array<struct<{schema}>>"))


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the last row's value by order: what a lookup file says in the end."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def _members(path: str, content: bytes, pattern: str) -> Iterator[tuple[str, str, int, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.search(pattern, n)):
            with z.open(name) as member:
                for k, line in enumerate(io.TextIOWrapper(member, "utf-8-sig", newline="")):
                    yield path, name, k + 1, line.rstrip("\r\n")


def _mapped(df: DataFrame, function, columns: list[tuple[str, pa.DataType]], schema: str, at_once: int = 5000) -> DataFrame:
    """mapInArrow of (path, content) files to rows."""
    ship(df.sparkSession)
    arrow = pa.schema(columns)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in function(path, content):
                    held.append(row)
                    if len(held) == at_once:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def zip_lines(spark: SparkSession, path: str, pattern: str = r"\.txt$") -> DataFrame:
    """(path, member, line, value): lines of the members of ZIP files; a task reads an archive at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    columns = [("path", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string())]
    return _mapped(files, lambda p, c: _members(p, c, pattern), columns, "path string, member string, line long, value string")


def piped(lines: DataFrame, schema: str, sep: str = "|") -> DataFrame:
    """Fields of lines (path, member, line, value), the header line left out."""
    return lines.filter("line > 1 and trim(value) != ''").select("member", "line", F.from_csv("value", schema, {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("row")).select("member", "line", "row.*")


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes, sheet: int) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a workbook's sheet; shared and inline strings; gaps between cells are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in ElementTree.parse(f).getroot().findall(MAIN + "si")]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != MAIN + "row":
                    continue
                cells: list[str | None] = []
                for cell in row.findall(MAIN + "c"):
                    column = 0
                    for letter in re.match("[A-Z]+", cell.get("r", "A"))[0]:
                        column = 26 * column + ord(letter) - 64
                    cells += [None] * (column - 1 - len(cells))
                    value = cell.find(MAIN + "v")
                    if cell.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter(MAIN + "t")))
                    else:
                        cells.append(None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text)
                yield int(row.get("r", 0)), cells
                row.clear()


def workbook_rows(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, cells): rows of the sheets of XLSX files; a task reads a workbook at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    columns = [("path", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))]
    return _mapped(files, lambda p, c: ((p, n, cells) for n, cells in _sheet_rows(c, sheet)), columns, "path string, row long, cells array<string>")


# Artifacts.
def write_lines(lines: DataFrame, path: str, order: str, tasks: int = 8, end: bytes = b"\n", packed: bool = True) -> DataFrame:
    """(name, lines, bytes, sha256) of the files written: lines (value) in order of a column, by ranges, one file each,
    gzip without time stamps, so that equal lines give equal bytes. A lost attempt's files are never listed."""
    spark = lines.sparkSession
    ship(spark)
    arrow = pa.schema([("name", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    suffix = ".gz" if packed else ""

    def run(batches):
        from uuid import uuid4

        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        name, n = f"part-{uuid4().hex}.txt{suffix}", 0
        digest, size = hashlib.sha256(), 0
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                own = b"".join((v or "").encode() + end for v in batch.column(0).to_pylist())
                n += batch.num_rows
                data = gzip.compress(own, mtime=0) if packed else own
                digest.update(data)
                size += len(data)
                out.write(data)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, n, size, digest.hexdigest()), arrow, strict=True)], schema=arrow)

    dealt = lines.repartitionByRange(tasks, order).sortWithinPartitions(order).select("value")
    return written(dealt.mapInArrow(run, "name string, lines long, bytes long, sha256 string"), folder(spark, "manifest"))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, intact): whether each listed file is there with the checksum that the list states."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.join(found, "name", "left").select("name", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("intact"))
