"""Suppliers, then customers, published as organisations through staged records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.publication import CLASSIFIED, CONTESTED, SEVERAL, publish
from ..operators.store import Store
from ..shared import folder
from .base import query, table

_STATE = "concat('S', CAST(s_nationkey AS STRING))"
_BASE = 1_000_000_000
_CUSTOMERS = f"""CASE c_custkey % 6 WHEN 0 THEN concat('reg::R', CAST(c_custkey % 10 AS STRING)) WHEN 1 THEN concat('reg::R', CAST(c_custkey % 10 AS STRING), '|reg::R', CAST((c_custkey + 3) % 10 AS STRING))
WHEN 2 THEN concat('new::N', CAST(CAST(floor(c_custkey / 12) AS BIGINT) AS STRING), '|own::O', CAST(c_custkey AS STRING)) WHEN 3 THEN concat('new::M', CAST(c_custkey AS STRING), '|aux::A', CAST(CAST(floor(c_custkey / 12) AS BIGINT) AS STRING))
WHEN 4 THEN '' ELSE concat('new:S1:P', CAST(c_custkey AS STRING)) END"""
#: Each staged record, its identifiers as text: system:state:value between bars.
STAGED = {
    "supplier": f"""SELECT s_suppkey AS id, 'registry' AS source, CAST(s_suppkey AS STRING) AS record_key, 'agency' AS type, 'state' AS level, s_name AS name, lower(s_name) AS name_key, CAST(NULL AS STRING) AS website_raw, CAST(NULL AS STRING) AS website,
CAST(NULL AS STRING) AS review_reason, concat('reg::R', CAST(s_suppkey AS STRING), '|tax:', {_STATE}, ':T', CAST(s_suppkey AS STRING)) AS named, '1 Main' AS line1, '' AS city, 'd0' AS document, 'v0' AS version, CAST('2024-01-01' AS TIMESTAMP) AS seen FROM supplier""",
    "customer": f"""SELECT {_BASE} + c_custkey AS id, concat('list', CAST(c_custkey % 2 AS STRING)), CAST(c_custkey AS STRING), CASE WHEN c_custkey % 12 = 0 THEN 'agency' ELSE c_mktsegment END, CASE WHEN c_custkey % 24 = 12 THEN 'state' WHEN c_custkey % 4 <> 1 AND c_custkey % 48 > 0 THEN 'city' END, c_name, lower(c_name), CASE WHEN c_custkey % 3 > 0 THEN concat(' http://', c_name, '.org') END,
CASE WHEN c_custkey % 3 > 0 THEN concat('http://', lower(c_name), '.org') END, CASE WHEN c_custkey % 7 = 3 THEN 'unclear' END, {_CUSTOMERS}, CASE WHEN c_custkey % 2 = 0 THEN '1 Main' END, CASE WHEN c_custkey % 5 > 0 THEN concat('C', CAST(c_nationkey AS STRING)) END,
'd1', concat('v', CAST(c_custkey % 9 AS STRING)), CAST('2024-02-01' AS TIMESTAMP) FROM customer""",
}
_I = """i AS (SELECT id, k AS place, split_part(x, ':', 1) AS system, nullif(split_part(x, ':', 2), '') AS state, split_part(x, ':', 3) AS value FROM (SELECT id, unnest(string_split(named, '|')) AS x, unnest(range(len(string_split(named, '|')))) AS k FROM a WHERE named <> ''))"""
_SQL = f"""WITH a AS ({STAGED["supplier"]} UNION ALL {STAGED["customer"]}), {_I}, k AS (SELECT system, state, value, id AS organization FROM i WHERE id < {_BASE}), c AS (SELECT * FROM i WHERE id >= {_BASE}),
o AS (SELECT c.id, count(DISTINCT organization) AS owners, min(organization) AS owner FROM c JOIN k ON c.system = k.system AND c.state IS NOT DISTINCT FROM k.state AND c.value = k.value GROUP BY 1),
f AS (SELECT id, min(id) OVER (PARTITION BY system, state, value) AS founder FROM c WHERE place = 0),
l AS (SELECT f.id, coalesce(owner, founder) AS organization, CASE WHEN owners > 1 THEN '{SEVERAL}' WHEN owners = 1 AND (type <> 'agency' OR level <> 'state') THEN '{CLASSIFIED}' END AS hold FROM f JOIN a ON a.id = f.id LEFT JOIN o ON o.id = f.id),
t AS (SELECT system, state, value FROM c JOIN l ON l.id = c.id WHERE hold IS NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT organization) > 1),
m AS (SELECT id, organization, coalesce(hold, CASE WHEN id IN (SELECT c.id FROM c JOIN t ON c.system = t.system AND c.state IS NOT DISTINCT FROM t.state AND c.value = t.value) THEN '{CONTESTED}' END) AS hold FROM l UNION ALL SELECT id, id, NULL FROM a WHERE id < {_BASE}),
r AS (SELECT a.*, organization, hold FROM a JOIN m ON m.id = a.id), g AS (SELECT * FROM r WHERE hold IS NULL)
SELECT 'organizations' AS kind, CAST(organization AS VARCHAR) AS key, arg_min(name, id) || '|' || arg_min(type, id) || '|' || coalesce(first(level ORDER BY id), '-') || '|' || coalesce(arg_min(website, id), '-') AS value, arg_min(seen, id) AS first_seen, max(seen) AS last_seen FROM g GROUP BY organization
UNION ALL SELECT 'identifiers', system || '|' || coalesce(state, '-') || '|' || value, arg_min(organization, i.id) || '|' || bool_or(place = 0 AND i.id = chief), min(seen), max(seen) FROM i JOIN g ON g.id = i.id JOIN (SELECT organization AS org, min(id) AS chief FROM g GROUP BY 1) ON org = organization GROUP BY system, state, value
UNION ALL SELECT DISTINCT 'observations', version || '|' || source || ':' || record_key || '|name', name || '|' || name_key, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM g
UNION ALL SELECT DISTINCT 'observations', version || '|' || source || ':' || record_key || '|website_url', website_raw || '|' || website, NULL, NULL FROM g WHERE website_raw IS NOT NULL
UNION ALL SELECT DISTINCT 'locations', organization || '|' || document, coalesce(line1, '-') || '|' || coalesce(nullif(city, ''), '-'), NULL, NULL FROM g WHERE line1 IS NOT NULL OR nullif(city, '') IS NOT NULL
UNION ALL SELECT 'records', CAST(a.id AS VARCHAR), CASE WHEN m.id IS NULL THEN 'ready_to_import' WHEN hold IS NOT NULL THEN 'reconciliation_hold' WHEN level IS NULL OR review_reason IS NOT NULL THEN 'classification_hold' ELSE 'imported' END || '|' || coalesce(CAST(CASE WHEN hold IS NULL THEN organization END AS VARCHAR), '-')
|| '|' || coalesce(nullif(concat_ws('; ', review_reason, hold), ''), '-'), NULL, NULL FROM a LEFT JOIN m ON m.id = a.id"""


def staged(spark, d, name: str) -> DataFrame:
    own = spark.sql(STAGED[name].replace(f"FROM {name}", "FROM {own}"), own=table(spark, d, name))
    own = own.toDF("id", "source", "record_key", "type", "level", "name", "name_key", "website_raw", "website", "review_reason", "named", "line1", "city", "document", "version", "seen")
    part = lambda x, k: F.split_part(x, F.lit(":"), F.lit(k))
    each = F.transform(F.filter(F.split("named", r"\|"), lambda x: x != ""), lambda x: F.struct(part(x, 1).alias("system"), part(x, 2).alias("state"), part(x, 3).alias("value")))
    none = F.lit(None).cast("string")
    where = F.struct(F.col("line1"), none.alias("line2"), F.col("city"), none.alias("state"), none.alias("postal"))
    return own.withColumn("identifiers", each).withColumn("location", where).withColumn("status", F.lit("ready_to_import")).withColumn("domain", none).withColumn("jurisdiction", none)


@query(_SQL)
def e9_n5_n7_published(spark, d):
    """Match, holds, links, identifiers, observations, locations and statuses of two batches, one commit each."""
    store = Store(spark, folder(spark, "publication"), buckets=8)
    for batch, name in enumerate(("supplier", "customer")):
        publish(store, staged(spark, d, name), batch)
    shown = {"organizations": (["organization"], ["name", "type", "level", "website"]), "identifiers": (["system", "state", "value"], ["organization", "is_primary"]), "observations": (["version", "record_key", "field"], ["value_raw", "value"]), "locations": (["organization", "document"], ["line1", "city"]), "records": (["id"], ["status", "organization", "reason"])}
    joined = lambda cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cs])
    out = []
    for name, (key, value) in shown.items():
        rows = store.read(name)
        seen = [F.col(c) if c in rows.columns else F.lit(None).cast("timestamp").alias(c) for c in ("first_seen", "last_seen")]
        out.append(rows.select(F.lit(name).alias("kind"), joined(key).alias("key"), joined(value).alias("value"), *seen))
    return reduce(DataFrame.union, out)
