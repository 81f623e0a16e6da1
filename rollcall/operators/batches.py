"""Batches of jobs: leases that ran out, limits that were met, batches that are settled or still have work."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("queued", "claimed", "running")
LEASE, LIMIT = "lease expired before completion", "batch limit reached"


def _instant(at: Column | datetime) -> Column:
    return at if isinstance(at, Column) else F.lit(at)


def recovered(jobs: DataFrame, at: Column | datetime) -> DataFrame:
    """jobs (status, attempts, most_attempts, leased_until, finished_at, last_error, and others): claimed or running ones
    whose lease ran out by `at` are queued again while attempts are left, and failed after the last one."""
    out = F.col("status").isin("claimed", "running") & (F.col("leased_until") <= _instant(at))
    again = F.col("attempts") < F.col("most_attempts")
    now = {
        "status": F.when(out & again, "queued").when(out, "failed").otherwise(F.col("status")),
        "finished_at": F.when(out, F.when(~again, _instant(at))).otherwise(F.col("finished_at")),
        "last_error": F.when(out, LEASE).otherwise(F.col("last_error")),
        "leased_until": F.when(~F.coalesce(out, F.lit(False)), F.col("leased_until")),
    }
    return jobs.select(*[now[c].alias(c) if c in now else F.col(c) for c in jobs.columns])


def spent() -> Column:
    """Whether a batch has met its limit of pages or errors."""
    return (F.col("pages") >= F.col("page_limit")) | (F.col("errors") >= F.col("error_limit"))


def limited(jobs: DataFrame, batches: DataFrame, at: Column | datetime) -> DataFrame:
    """jobs, the queued ones of batches that met a limit cancelled."""
    over = batches.filter(spent()).select("batch", F.lit(True).alias("over"))
    own = jobs.join(over, "batch", "left").withColumn("over", F.coalesce("over", F.lit(False)) & (F.col("status") == "queued"))
    now = {"status": F.lit("cancelled"), "finished_at": _instant(at), "last_error": F.lit(LIMIT)}
    return own.select(*[F.when(F.col("over"), now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in jobs.columns])


def settled(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """batches (batch, status, errors, and others): queued or running ones without an open job are completed, with errors if
    they met any or a job failed, was held, cancelled, or ended with a remark (outcome)."""
    bad = F.col("status").isin("failed", "policy_hold", "cancelled") | F.col("outcome").isNotNull()
    each = jobs.groupBy("batch").agg(F.coalesce(F.bool_or(F.col("status").isin(*OPEN)), F.lit(False)).alias("open"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
    own = batches.join(each, "batch", "left")
    ends = F.col("status").isin("queued", "running") & ~F.coalesce("open", F.lit(False))
    status = F.when(ends, F.when((F.col("errors") > 0) | F.coalesce("bad", F.lit(False)), "completed_with_errors").otherwise("completed")).otherwise(F.col("status"))
    return own.select(*[status.alias(c) if c == "status" else F.col(c) for c in batches.columns])


def pending(batches: DataFrame, jobs: DataFrame, projects: DataFrame, at: Column | datetime) -> DataFrame:
    """(batch) that still has work: an open job, an active project, a batch in progress within its time and limits."""
    live = batches.filter(F.col("status").isin("queued", "running") & (F.col("expires_at").isNull() | (F.col("expires_at") > _instant(at))) & ~spent())
    live = live.join(projects.filter("status = 'active'").select("project"), "project", "left_semi")
    return live.join(jobs.filter(F.col("status").isin(*OPEN)).select("batch"), "batch", "left_semi").select("batch")


def dangling(references: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """(kind, code, names): codes that name what isn't there. references: (kind, table, its code, the column that names, the
    named table, its code); null names nothing. A report for each pair of tables, by anti join."""
    out = None
    for kind, rows, code, column, named, key in references:
        lost = rows.filter(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(code).cast("string").alias("code"), F.col(column).alias("names"))
        lost = lost.join(named.select(F.col(key).alias("names")), "names", "left_anti").select("kind", "code", F.col("names").cast("string").alias("names"))
        out = lost if out is None else out.union(lost)
    return out.distinct()


def assert_coherent(report: DataFrame) -> None:
    """ValueError with the first of them if any code names what isn't there."""
    first = report.orderBy("kind", "code").limit(5).collect()
    if first:
        raise ValueError("unknown codes: " + ", ".join(f"{r.kind} {r.code} names {r.names}" for r in first))
