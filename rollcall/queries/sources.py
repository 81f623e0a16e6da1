"""Sources and sinks over files that are first written from the given tables, into the folder all workers share."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import folder
from ..shipping import ship
from ..sinks import csv_cell, csv_lines, upserted
from ..sources import delimited as D
from ..sources import files as S
from .base import query, table


def _text(df: DataFrame, name: str, sep: str = "\n", compression: str = "none") -> str:
    path = folder(df.sparkSession, name)
    df.write.text(path, lineSep=sep, compression=compression)
    return path


NAMES = "CASE s_suppkey % 4 WHEN 0 THEN s_name || ', Inc.' WHEN 1 THEN 'The \"' || s_name || '\"' WHEN 2 THEN 'two' || chr(10) || 'lines' ELSE s_name END"


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS id, {NAMES} AS name, NULL AS note FROM supplier""")
def s1_s4_delimited(spark, d):
    """A header with a byte order mark, quoted commas, quotes and newlines, blank records; then the same by tabs."""
    name = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat(s_name, ', Inc.') WHEN 1 THEN concat('The \"', s_name, '\"') WHEN 2 THEN concat('two', char(10), 'lines') ELSE s_name END")
    own = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), name.alias("name"))
    comma, tab = (own.filter(F.col("id").cast("long") % 2 == k) for k in (0, 1))
    header = lambda sep: f"{D.BOM}id{sep}name{sep}note\r\n{sep} {sep}\r\n"
    lines = lambda df, sep: df.select(F.concat_ws(sep, csv_cell(F.col("id")), csv_cell(F.col("name")), F.lit("")).alias("value"))
    a = D.read_strings(spark, _headed(lines(comma, ","), header(","), "csv"))
    return a.union(D.read_strings(spark, _headed(lines(tab, "\t"), header("\t"), "tsv"), sep="\t", strict=True))


RECORDS = 20_000  # of a file with quoted line ends, which one task reads


def _headed(lines: DataFrame, header: str, name: str) -> str:
    """Files of some RECORDS lines, at least two files, each begun by its header."""
    path = folder(lines.sparkSession, name)
    own = lines.repartition(2 + lines.count() // RECORDS)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, which is a file
    own.select(F.concat(F.when(first, header).otherwise(""), "value").alias("value")).write.text(path, lineSep="\r\n")
    return path


@query("""SELECT 's' || s_suppkey AS "supplier name", CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'a b' END AS note FROM supplier""")
def s3_objects(spark, d):
    own = table(spark, d, "supplier").select(F.concat(F.lit(" s"), "s_suppkey", F.lit("  ")).alias("supplier   name"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("a \t b")).alias(" note "))
    return D.objects(own)


@query("""SELECT row, CASE WHEN name IS NULL THEN 'missing name' WHEN n > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY name IS NULL, coalesce('id:' || id, 'name|' || type || '|' || name) ORDER BY row) AS n FROM
(SELECT p_partkey AS row, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey % 300 AS VARCHAR) END AS id, lower(p_type) AS type, CASE WHEN p_size % 7 = 0 THEN NULL ELSE lower(p_name) END AS name FROM part))""")
def s5_imported_organizations(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, (F.col("p_partkey") % 300).cast("string")).alias("Id"), F.col("p_type").alias("Kind"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("Name of body"))
    kept, rejects = D.imported(p, {"id": "Id", "type": "Kind", "name": "Name of body"}, ["name"], "p_partkey")
    return kept.select("row", F.lit("kept").alias("outcome")).union(rejects.select("row", F.col("reason").alias("outcome")))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, s_suppkey % 2 = 0 AS packed FROM supplier""")
def s6_k4_json_lines(spark, d):
    """Artifacts of one JSON object a line, plain and gzip, read back with their line numbers."""
    own = table(spark, d, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("packed"))).alias("value"))
    plain = S.numbered_lines(spark, _text(own.filter("value like '%false%'"), "jsonl"))
    packed = S.numbered_lines(spark, _text(own.filter("value like '%true%'"), "jsonl", compression="gzip"))
    both = plain.union(packed)
    last = both.groupBy("file").agg(F.max("line").alias("most"), F.count("*").alias("n")).filter("most = n")
    rows = both.join(last.select("file"), "file", "left_semi").select(F.from_json("value", "id bigint, name string, packed boolean").alias("r"))
    return rows.select("r.*")


def _archived(df: DataFrame, name: str, make) -> str:
    """A file for each group (name, lines) that make(lines) turns into bytes."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    ship(spark)

    def run(batches):
        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for lines in batch.column(0).to_pylist():
                with where.open_output_stream(f"{root}/{uuid.uuid4().hex}", compression=None) as out:
                    out.write(make(lines))
        yield pa.RecordBatch.from_pydict({"done": [True]})

    df.select("lines").mapInArrow(run, "done boolean").count()
    return path


def _zipped(lines: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("places.txt", "﻿KEY|NAME|REGION\n" + "".join(f"{x} \n" for x in lines))
        z.writestr("readme.md", "not a member that is read")
    return out.getvalue()


def _workbook(lines: list[str]) -> bytes:
    names = [escape(x) for x in lines]
    rows = "".join(f'<row r="{k + 1}"><c r="A{k + 1}"><v>{k}</v></c><c r="C{k + 1}" t="s"><v>{k}</v></c><c r="D{k + 1}" t="inlineStr"><is><t>in</t></is></c></row>' for k in range(len(names)))
    head = '<?xml version="1.0"?>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"{head}<sst {ns}>" + "".join(f"<si><r><t>{x[:3]}</t></r><r><t>{x[3:]}</t></r></si>" for x in names) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"{head}<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


@query("""SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation""")
def s7_zipped_gazetteer(spark, d):
    own = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"))).alias("lines"))
    return S.piped(S.zip_lines(spark, _archived(own, "zip", _zipped)), "key bigint, name string, region bigint").select("key", "name", "region")


@query("""SELECT n_name AS name, 'in' AS inline, NULL AS gap, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS row FROM nation""")
def s8_workbook(spark, d):
    own = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("lines"))
    rows = S.workbook_rows(spark, _archived(own, "xlsx", _workbook))
    return rows.select(F.col("cells")[2].alias("name"), F.col("cells")[3].alias("inline"), F.col("cells")[1].alias("gap"), "row")


@query("""SELECT n_nationkey, n_name AS agency, 'https://' || lower(n_name) || '.gov' AS url FROM nation""")
def s9_html_index(spark, d):
    """One HTML text of agency blocks for each region, cut and scraped by patterns."""
    block = F.concat(F.lit('<li class="agency" data-id="'), "n_nationkey", F.lit('"><h3>'), "n_name", F.lit('</h3><a href="https://'), F.lower("n_name"), F.lit('.gov">site</a></li>'))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(block), "\n"), F.lit("</ul>")).alias("html"))
    blocks = pages.select(F.explode(F.slice(F.split("html", '<li class="agency"'), 2, 1 << 20)).alias("b"))
    of = lambda p: F.regexp_extract("b", p, 1)
    return blocks.select(of('data-id="(\\d+)"').cast("int").alias("n_nationkey"), of("<h3>([^<]*)</h3>").alias("agency"), of('href="([^"]*)"').alias("url"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation""")
def s10_json_array(spark, d):
    arrays = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("value")).select("value")
    path = folder(spark, "json")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return S.read_json_array(spark, path, "id bigint, name string")


@query("""SELECT s_suppkey, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS metric FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def s11_metric_lookup(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("place"))
    last = S.last_by_key(lines, "l_suppkey", "l_quantity", "place")
    return table(spark, d, "supplier").join(last, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.col("l_quantity").alias("metric"))


@query("""SELECT o_custkey, o_orderkey AS id, o_orderstatus AS status, kind FROM orders, (VALUES ('new'), ('old')) v(kind) WHERE o_custkey % 2 = 0""")
def s12_s14_relations_from_values(spark, d):
    """A JSON array as a relation, an array parameter exploded, inline values beside each row."""
    o = table(spark, d, "orders").filter("o_custkey % 2 = 0")
    nested = o.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("json"))
    rows = nested.select("o_custkey", S.inlined(F.col("json"), "id bigint, status string"))
    return rows.select("*", F.explode(F.array(F.lit("new"), F.lit("old"))).alias("kind"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN length(html) END AS size FROM pages""")
def s15_fixture_pages(spark, d):
    """Saved bodies by URL; pages that were not saved have none."""
    p = table(spark, d, "pages")
    saved = p.filter("page_id % 2 = 0").select(F.concat("url", F.lit("#"), "page_id").alias("key"), "html")
    wanted = p.select("page_id", F.concat("url", F.lit("#"), "page_id").alias("key"))
    return wanted.join(saved, "key", "left").select("page_id", F.length("html").cast("long").alias("size"))


@query("""SELECT s_suppkey, s_name, TRUE AS intact FROM supplier""")
def k1_k5_files_round_trip(spark, d):
    """CSV lines and packed JSON lines written in order with checksums, verified, and read back."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    path = folder(spark, "artifact")
    manifest = S.write_lines(s.select("s_suppkey", F.to_json(F.struct("s_name", "s_suppkey")).alias("value")), path, "s_suppkey", tasks=3 + s.count() // RECORDS)
    intact = S.verified_files(spark, path, manifest)
    whole = intact.agg(F.bool_and("intact").alias("intact"))
    back = S.read_json_lines(spark, path, "s_suppkey bigint, s_name string")
    csv = D.read_delimited(spark, _headed(csv_lines(s), "s_suppkey,s_name\r\n", "csv"), "s_suppkey bigint, s_name string")
    return back.intersect(csv).join(whole).select("s_suppkey", "s_name", "intact")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def k6_upserts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    stored = upserted(o.limit(0), o.filter("o_orderkey % 2 = 0"), ["o_custkey"], "o_orderkey")
    return upserted(stored, o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1""")
def t2_arrivals_ingested_once(spark, d):
    """Events that arrive as files in two batches, each taken once over a restart."""
    from ..streaming.incremental import arrivals, ingest

    source, target, state = (folder(spark, x) for x in ("arrivals", "ingested", "state"))
    e = table(spark, d, "events").select("event_id", "user_id")
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        ingest(arrivals(spark, source, "event_id bigint, user_id bigint"), target, state).awaitTermination()
    return spark.read.parquet(target).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def t4_windows_only_widen(spark, d):
    """Seen windows by hour and type over a stream of files: late rows widen them, in either direction."""
    from ..streaming.incremental import arrivals, seen_windows

    source, state = folder(spark, "arrivals"), folder(spark, "state")
    e = table(spark, d, "events").select("ts", "event_type", "event_id")
    e.repartition(4, "event_id").write.parquet(source)
    name = "rollcall_" + uuid.uuid4().hex
    target = folder(spark, name)
    seen_windows(arrivals(spark, source, "ts timestamp, event_type string, event_id bigint"), "ts", ["event_type"], target, state).awaitTermination()
    rows = spark.read.parquet(target)
    # Each trigger writes what a window holds by then; of these the widest is the last.
    return rows.groupBy("hour", "event_type").agg(F.max("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
