"""Suppression by scope: each scope is an equality join, never a single OR-ed condition; broad ones are salted."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.emails import domain
from ..functions.urls import domain_suffixes

#: Scopes, the most specific first, and the subject's column that each is held against.
SCOPES = {
    "email": "address",
    "person": "person",
    "organization": "org",
    "organization_subtree": "org",
    "domain": "address",
    "source": "source",
    "jurisdiction": "jurisdiction",
    "geographic_area": "areas",
    "government_level": "level",
    "export_purpose": "purpose",
    "global": None,
}


#: Scopes of few values, or none: their subjects are dealt over SALTS tasks, to each of which all their entries go.
BROAD = {"jurisdiction", "government_level", "export_purpose", "global"}
SALTS = 32


def in_force(at: Column) -> Column:
    """effective_at <= at < expires_at, and not revoked."""
    return (F.col("effective_at") <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") > at)) & F.col("revoked_at").isNull()


def withheld(df: DataFrame, entries: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """df without rows that an entry (scope, value) names; scopes: scope -> column of df."""
    for scope, column in scopes.items():
        own = entries.filter(F.col("scope") == scope).select(F.col("value").alias("_value")).distinct()
        df = df.join(own, F.col(column).cast("string") == F.col("_value"), "left_anti")
    return df


def matches(subjects: DataFrame, entries: DataFrame, key: str, at: Column | datetime, ancestors: DataFrame | None = None) -> DataFrame:
    """(key, entry, scope, rank, via): all entries (entry, scope, value, effective_at, expires_at, revoked_at) in force
    that name a subject; rank 0 is the most specific scope.

    Subjects have a key and those columns of SCOPES that apply; areas is an array. A domain entry covers its
    subdomains, a subtree entry all organisations below it by ancestors (node, ancestor). via names the domain or
    organisation that matched where it isn't the subject's own. Values are compared trimmed and in lower case.
    """
    now = entries.filter(in_force(at if isinstance(at, Column) else F.lit(at)))
    now = now.select("entry", "scope", F.lower(F.trim("value")).alias("value"))
    low = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    none = F.lit(None).cast("string")
    found = []
    for rank, (scope, column) in enumerate(SCOPES.items()):
        if column is not None and column not in subjects.columns:
            continue
        own = now.filter(F.col("scope") == scope)
        if scope == "global":  # every subject
            named = subjects.select(key, F.lit("*").alias("value"), none.alias("via"))
            own = own.withColumn("value", F.lit("*"))
        elif scope == "domain":
            own = own.withColumn("value", F.regexp_replace("value", "^@", ""))
            host = domain(F.trim(F.col(column)))
            named = subjects.filter(F.col(column).contains("@")).select(key, F.explode(domain_suffixes(host)).alias("value"), host.alias("host"))
            named = named.select(key, "value", F.when(F.col("value") != F.col("host"), F.col("value")).alias("via"))
        elif scope == "organization_subtree":
            named = subjects.select(key, low(column).alias("value"), none.alias("via"))
            if ancestors is not None:
                up = ancestors.select(F.col("node").cast("string").alias("own"), low("ancestor").alias("value")).filter("lower(own) != value").distinct()
                above = subjects.select(key, F.col(column).cast("string").alias("own")).join(up, "own")
                named = named.union(above.select(key, "value", F.col("value").alias("via")))
        elif scope == "geographic_area":
            named = subjects.select(key, F.explode(F.array_distinct(F.transform(F.col(column).cast("array<string>"), lambda a: F.lower(F.trim(a))))).alias("value"), none.alias("via"))
        else:
            named = subjects.select(key, low(column).alias("value"), none.alias("via"))
        by = ["value"]
        if scope in BROAD:
            by.append("salt")
            named = named.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
            own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        found.append(named.join(own, by).select(key, "entry", "scope", F.lit(rank).alias("rank"), "via"))
    return reduce(DataFrame.union, found)


def decided(subjects: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """subjects with suppressed and the scope and entry that say so, the most specific and then the first by id."""
    best = found.groupBy(key).agg(F.min(F.struct("rank", "entry", "scope")).alias("best"), F.count_distinct("entry").alias("n"))
    out = subjects.join(best, key, "left")
    return out.select(*[subjects[c] for c in subjects.columns], F.col("best").isNotNull().alias("suppressed"), F.col("best.scope").alias("by_scope"), F.col("best.entry").alias("by_entry"), F.coalesce("n", F.lit(0)).alias("entries"))


def parted(subjects: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(allowed, suppressed) subjects."""
    named = found.select(key).distinct()
    return subjects.join(named, key, "left_anti"), subjects.join(named, key, "left_semi")


def assert_none(subjects: DataFrame, found: DataFrame, key: str) -> None:
    """Raises ValueError if any subject is named: the last check before a file is written."""
    if not subjects.select(key).join(found.select(key), key, "left_semi").isEmpty():
        raise ValueError("a suppressed record was about to be published")
