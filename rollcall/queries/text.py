"""Text, cell and hash functions over whole texts and derived cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import query, table

WHITE = r"regexp_replace(regexp_replace({0}, '[\x{{00A0}}\x{{2007}}\x{{202F}}\x{{2009}}\x{{2002}}\x{{2003}}\t\r\n]', ' ', 'g'), ' {{2,}}', ' ', 'g')"


def sql_white(c: str) -> str:
    return f"trim({WHITE.format(c)})"


def sql_key(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({sql_white(c)})), '[^a-z0-9]+', '-', 'g'), '-')"


def sql_calm(c: str, titled: str) -> str:
    """The titled form where three letters or more are all capital, else the text itself."""
    letters = f"regexp_replace({c}, '[^A-Za-z]', '', 'g')"
    return f"CASE WHEN length({letters}) >= 3 AND {letters} = upper({letters}) THEN {titled} ELSE {c} END"


@query(f"""SELECT doc_id, sha256({sql_white("text")}) AS collapsed, CASE WHEN length({sql_white("text")}) > 300 THEN substr({sql_white("text")}, 1, 299) || '…' ELSE {sql_white("text")} END AS snippet FROM documents""")
def x1_x26_collapse_snippet(spark, d):
    c = T.collapse_whitespace(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("collapsed"), T.snippet(c).alias("snippet"))


@query(f"""SELECT doc_id, sha256({sql_key("text")}) AS key, sha256(trim(regexp_replace(lower({sql_white("text")}), '[^a-z0-9]+', '-', 'g'), '-')) AS plain FROM documents""")
def x2_x24_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.key_of(F.col("text")), 256).alias("key"), F.sha2(T.plain_key(F.col("text")), 256).alias("plain"))


@query("""SELECT c_custkey, c_mktsegment || ' O''' || c_mktsegment AS raw, substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || ' O''' || substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) AS calm,
'Mixed ' || c_mktsegment AS mixed, length(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) >= 3 AS shouting FROM customer""")
def x3_casing(spark, d):
    raw = F.concat("c_mktsegment", F.lit(" O'"), "c_mktsegment")
    mixed = F.concat(F.lit("Mixed  "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", raw.alias("raw"), T.calm(raw).alias("calm"), T.calm(mixed).alias("mixed"), T.is_shouting(F.col("c_mktsegment")).alias("shouting"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'north-' WHEN 1 THEN 'st-mary-' WHEN 2 THEN 'usda-' ELSE 'isd-' END || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '' ELSE '-x' END AS key FROM supplier""")
def x4_x6_organization_keys(spark, d):
    head = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'North Independent School District ' WHEN 1 THEN 'St. Mary School District ' WHEN 2 THEN 'U.S.D.A. ' ELSE 'I.S.D. Board of Supervisors ' END")
    tail = F.expr("CASE s_suppkey % 3 WHEN 0 THEN ' SCHOOL DISTRICT' ELSE ' x' END")
    raw = F.concat(head, F.col("s_suppkey").cast("string"), tail)
    return table(spark, d, "supplier").select("s_suppkey", T.organization_key(raw, ["School District", "Independent School District", "Board of Supervisors"]).alias("key"))


@query("""SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'Nation ' ELSE 'Land of Oz ' END || chr(65 + n_nationkey) || 'x' AS county FROM nation""")
def x5_county_names(spark, d):
    own = F.concat(F.expr("CASE n_nationkey % 2 WHEN 0 THEN 'Nation ' ELSE 'Land of Oz ' END"), F.expr("char(65 + n_nationkey)"), F.lit("x"))
    forms = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("County of "), own)).when(F.col("n_nationkey") % 5 == 1, F.concat(own, F.lit(" COUNTY"))).when(F.col("n_nationkey") % 5 == 2, F.concat(own, F.lit(" Co.")))
    raw = forms.when(F.col("n_nationkey") % 5 == 3, F.concat(own, F.lit("  parish "))).otherwise(F.concat(own, F.lit(",")))
    return table(spark, d, "nation").select("n_nationkey", T.county_name(raw).alias("county"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Human Resources' WHEN 1 THEN 'Public Works' WHEN 2 THEN 'Parks and Recreation' WHEN 3 THEN p_name ELSE 'Finance' END AS unit FROM part""")
def x7_unit_names(spark, d):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'HR' WHEN 1 THEN 'D.P.W.' WHEN 2 THEN 'Parks & Rec' WHEN 3 THEN concat(p_name, ' Department') ELSE 'Fiscal  Services' END")
    # 'D.P.W.' is spelled with dots; the alias knows the word.
    raw = F.when(F.col("p_partkey") % 5 == 1, T.joined_acronyms(raw)).otherwise(raw)
    return table(spark, d, "part").select("p_partkey", T.unit_name(raw).alias("unit"))


@query(r"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}'), lambda p: substr(p, 5, 3) || '-' || substr(p, 10, 8)))) AS phones
FROM documents WHERE regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')""")
def x8_phones(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.transform(found, T.phone))).alias("phones")).filter(F.size("phones") > 0)


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '555-' || substr(p, 1, 3) || '-' || substr(p, 4, 4) WHEN 1 THEN '555-' || substr(p, 1, 3) || '-' || substr(p, 4, 4) || ' ext 42' WHEN 2 THEN NULL
ELSE '555-' || substr(p, 1, 3) || '-' || substr(p, 4, 4) END AS phone FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS p FROM customer)""")
def x8_phone_forms(spark, d):
    p = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    a, b = F.substring(p, 1, 3), F.substring(p, 4, 4)
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("1 (555) "), a, F.lit("."), b)).when(k == 1, F.concat(F.lit("555."), a, F.lit("."), b, F.lit(" Ext. 42"))).when(k == 2, F.concat(a, b)).otherwise(F.concat(F.lit("555"), a, b))
    return table(spark, d, "customer").select("c_custkey", T.phone(raw).alias("phone"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 12 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN p_size = 20 THEN 'KG' WHEN p_size = 21 THEN 'PK' END AS grade FROM part""")
def x19_grades(spark, d):
    raw = F.expr("CASE WHEN p_size = 20 THEN 'kindergarten' WHEN p_size = 21 THEN 'Pre-K' WHEN p_size % 2 = 0 THEN concat('Grade ', p_size) ELSE concat(' 0', p_size, 'th') END")
    return table(spark, d, "part").select("p_partkey", T.grade(raw).alias("grade"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') ELSE '' END AS zip,
o_orderpriority || ', ' || o_orderstatus AS address, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS cell FROM orders""")
def x23_cells(spark, d):
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(
        "o_orderkey",
        T.number(F.concat(F.lit(" '"), F.format_number(F.floor("o_totalprice"), 0))).alias("price"),
        T.iso_date(day).alias("day"),
        T.zip_code(F.concat(F.lit("'"), (F.col("o_custkey") % 100000).cast("string")), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 10000).cast("string"))).alias("zip"),
        T.address(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus")).alias("address"),
        T.cell(F.when(F.col("o_orderkey") % 3 == 0, F.lit(" '")).otherwise(F.concat(F.lit("' "), "o_orderpriority"))).alias("cell"),
    )


@query("""SELECT c_custkey, coalesce(r_name, n_name) AS area FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_nationkey""")
def x22_canonical_areas(spark, d):
    aliases = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.join(aliases, F.col("k") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("r_name", "n_name").alias("area"))


_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(f"""SELECT page_id, sha256({_TEXT}) AS content FROM pages""")
def x25_text_content(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.text_content(F.col("html")), 256).alias("content"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(1.0, greatest(0.0, l_quantity / 25 - 0.5)) AS share FROM lineitem""")
def x27_clamped_shares(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.share(F.col("l_quantity") / 25 - 0.5).alias("share"))


@query("""SELECT c_custkey, substr(sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END, ''), c_mktsegment)), 1, 24) AS record_key,
sha256('{"balance":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END || ',"name":"' || c_name || '","zone":"' || c_mktsegment || '"}') AS object_hash FROM customer""")
def x59_x60_record_keys(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    own = T.stable_json(zone=F.col("c_mktsegment"), balance=F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")), name=F.col("c_name"))
    return c.select("c_custkey", T.record_key(F.col("c_custkey"), name, F.col("c_mktsegment")).alias("record_key"), F.sha2(own, 256).alias("object_hash"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)\b[0-9a-f]{32,64}\b', '', 'g'),
'\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?\b', '', 'g'), '\s+', ' ', 'g'))) AS content_hash FROM pages""")
def x61_content_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", T.content_hash(F.col("html")).alias("content_hash"))
