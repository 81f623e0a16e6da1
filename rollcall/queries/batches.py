"""Batches of jobs over customers and their orders; references between the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from .base import query, table

AT = "2000-01-01"
#: Customers as batches, orders as their jobs, nations as projects.
BATCHES = """SELECT c_custkey AS batch, c_nationkey AS project, CASE c_custkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'running' ELSE 'cancelled' END AS status, c_custkey % 9 AS pages, 8 AS page_limit, c_custkey % 5 AS errors, 4 AS error_limit,
CASE WHEN c_custkey % 6 = 1 THEN CAST('1999-12-01' AS TIMESTAMP) END AS expires_at FROM {customer}"""
JOBS = """SELECT o_orderkey AS job, o_custkey AS batch, CASE CAST(floor(o_totalprice) AS BIGINT) % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'claimed' WHEN 2 THEN 'running' WHEN 3 THEN 'failed' ELSE 'done' END AS status, o_orderkey % 3 AS attempts, 2 AS most_attempts,
o_orderdate AS leased_until, CAST(NULL AS TIMESTAMP) AS finished_at, CAST(NULL AS STRING) AS last_error, CASE WHEN o_orderkey % 40 = 5 THEN 'partial' END AS outcome FROM {orders}"""
_JOBS = JOBS.format(orders="orders")
_OUT = f"status IN ('claimed', 'running') AND leased_until <= TIMESTAMP '{AT}'"
_NOW = f"""SELECT job, batch, outcome, attempts, CASE WHEN {_OUT} THEN CASE WHEN attempts < 2 THEN 'queued' ELSE 'failed' END ELSE status END AS status, CASE WHEN {_OUT} AND attempts >= 2 THEN TIMESTAMP '{AT}' END AS finished_at, CASE WHEN {_OUT} THEN '{B.LEASE}' END AS last_error FROM ({_JOBS})"""
_OVER = f"SELECT batch FROM ({BATCHES.format(customer='customer')}) WHERE pages >= page_limit OR errors >= error_limit"
_END = f"""SELECT job, batch, outcome, CASE WHEN status = 'queued' AND batch IN ({_OVER}) THEN 'cancelled' ELSE status END AS status, CASE WHEN status = 'queued' AND batch IN ({_OVER}) THEN TIMESTAMP '{AT}' ELSE finished_at END AS finished_at,
CASE WHEN status = 'queued' AND batch IN ({_OVER}) THEN '{B.LIMIT}' ELSE last_error END AS last_error FROM ({_NOW})"""


def _jobs(spark, d):
    return spark.sql(JOBS, orders=table(spark, d, "orders"))


def _batches(spark, d):
    return spark.sql(BATCHES, customer=table(spark, d, "customer"))


def _at():
    return F.lit(AT).cast("timestamp")


@query(f"SELECT job, status, finished_at, last_error FROM ({_END})")
def n12_recovered_jobs(spark, d):
    """Leases that ran out, then limits that were met."""
    return B.limited(B.recovered(_jobs(spark, d), _at()), _batches(spark, d), _at()).select("job", "status", "finished_at", "last_error")


@query(f"""SELECT b.batch, CASE WHEN status IN ('queued', 'running') AND NOT coalesce(open, FALSE) THEN CASE WHEN errors > 0 OR coalesce(bad, FALSE) THEN 'completed_with_errors' ELSE 'completed' END ELSE status END AS status FROM ({BATCHES.format(customer="customer")}) b
LEFT JOIN (SELECT batch, bool_or(status IN ('queued', 'claimed', 'running')) AS open, bool_or(status IN ('failed', 'policy_hold', 'cancelled') OR outcome IS NOT NULL) AS bad FROM ({_END}) GROUP BY 1) j ON j.batch = b.batch""")
def n12_settled_batches(spark, d):
    jobs = B.limited(B.recovered(_jobs(spark, d), _at()), _batches(spark, d), _at())
    return B.settled(_batches(spark, d), jobs).select("batch", "status")


@query(f"""SELECT batch FROM ({BATCHES.format(customer="customer")}) WHERE status IN ('queued', 'running') AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AT}') AND pages < page_limit AND errors < error_limit AND project % 3 > 0
AND batch IN (SELECT batch FROM ({_JOBS}) WHERE status IN ('queued', 'claimed', 'running'))""")
def n13_pending_batches(spark, d):
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("project"), F.when(F.col("n_nationkey") % 3 > 0, "active").otherwise("paused").alias("status"))
    return B.pending(_batches(spark, d), _jobs(spark, d), projects, _at())


@query("""SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS code, CAST(c_nationkey + 100 AS VARCHAR) AS names FROM customer WHERE c_custkey % 50 = 7 UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0)
UNION ALL SELECT DISTINCT 'order', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def n34_dangling_references(spark, d):
    """Codes that name what isn't there, over three pairs of tables."""
    c, n, o, r = (table(spark, d, t) for t in ("customer", "nation", "orders", "region"))
    lost = c.select("c_custkey", F.when(F.col("c_custkey") % 50 == 7, F.col("c_nationkey") + 100).when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("nation"))
    return B.dangling([("customer", lost, "c_custkey", "nation", n, "n_nationkey"), ("nation", n, "n_nationkey", "n_regionkey", r.filter("r_regionkey > 0"), "r_regionkey"), ("order", o, "o_orderkey", "o_custkey", c, "c_custkey")])
