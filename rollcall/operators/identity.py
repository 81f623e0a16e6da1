"""Organisations from arrivals: identity over tiers of evidence, conflicts, and folds that stronger evidence wins.

An arrival has a unique, ordered `record`, `observed`, and what is known of: identifier_system, identifier_state,
identifier_value; source_system, source_value; parent; jurisdiction; domain; type; name_key; document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import folder, written
from .components import components
from .ranks import running_max

#: Tiers of identity, the weakest first: fixed values.
TIERS = ("ambiguous", "domain_scoped_name", "parent_scoped_name", "source_identifier", "official_identifier")


def _print(tier: int, *parts: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.concat(*parts).alias("fingerprint"))


def fingerprints() -> Column:
    """An arrival's evidence, the strongest first, as an array of (tier, fingerprint): its official identifier, its
    source's identifier, and its name within a parent, within a domain and jurisdiction, or else within its document."""
    colon, scope = F.lit(":"), F.coalesce("jurisdiction", F.lit("-"))
    named = [colon, F.col("type"), colon, F.col("name_key")]
    official = F.when(F.col("identifier_value").isNotNull(), _print(4, F.lit("oid:"), "identifier_system", colon, F.coalesce(F.concat("identifier_state", colon), F.lit("")), "identifier_value"))
    source = F.when(F.col("source_value").isNotNull(), _print(3, F.lit("sid:"), "source_system", colon, "source_value"))
    name = (
        F.when(F.col("parent").isNotNull(), _print(2, F.lit("psn:"), scope, colon, "parent", *named))
        .when(F.col("domain").isNotNull() & F.col("jurisdiction").isNotNull(), _print(1, F.lit("dsn:"), "jurisdiction", colon, "domain", *named))
        .otherwise(_print(0, F.lit("amb:"), "document", *named))
    )
    return F.array_compact(F.array(official, source, name))


def same_evidence(c: Column) -> Column:
    """What makes two pieces of evidence one: case and runs of white space don't."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def resolved(arrivals: DataFrame) -> DataFrame:
    """arrivals with tier and fingerprint (the strongest evidence) and organization: the smallest record that a chain of
    shared evidence leads to."""
    own = written(arrivals.withColumn("evidence", fingerprints()), folder(arrivals.sparkSession, "identity"))
    links = own.select(F.col("record").alias("node"), F.explode("evidence.fingerprint").alias("key")).withColumn("key", same_evidence(F.col("key")))
    found = components(links).select(F.col("node").alias("record"), F.col("component").alias("organization"))
    best = F.col("evidence")[0]
    return own.join(found, "record").select(*[own[c] for c in arrivals.columns], best["tier"].alias("tier"), best["fingerprint"].alias("fingerprint"), "organization")


def conflicting(own: DataFrame) -> DataFrame:
    """(organization, identifier_system, identifier_state, identifiers): organisations whose evidence holds several
    identifiers of one system, which one body can't have; they wait for a person."""
    named = own.filter("identifier_value is not null").groupBy("organization", "identifier_system", "identifier_state")
    return named.agg(F.count_distinct("identifier_value").alias("identifiers")).filter("identifiers > 1")


def folded(own: DataFrame, latest: list[str], known: list[str]) -> DataFrame:
    """One row for each organisation of resolved(): arrivals in the order of record, the first inserts, a later one
    counts if its tier is no weaker than any before.

    latest: columns that the last arrival that counts gives; known: the last of these with a value; name: of these the
    last one observed no earlier than all before it; confidence: the greatest; tier and fingerprint: of the first of the
    strongest. first_seen is that of the first arrival, last_seen the latest of all. An organisation may hold any share
    of the arrivals: what came before is looked up by tier, or by ranges, never gathered.
    """
    # Read four times below, and dear: only what is asked for, once.
    wanted = ["organization", "record", "observed", "tier", "fingerprint", "name", "confidence", *latest, *known]
    own = written(own.select(*dict.fromkeys(wanted)), folder(own.sparkSession, "identity"))
    # Where each tier first came: an arrival counts if none stronger did before it.
    came = own.groupBy("organization").agg(*[F.min(F.when(F.col("tier") >= t, F.col("record"))).alias(f"_from_{t}") for t in range(1, len(TIERS))])
    stronger = F.coalesce(F.element_at(F.array(*[F.col(f"_from_{t}") for t in range(1, len(TIERS))], F.lit(None).cast("long")), F.col("tier") + 1), F.col("record"))
    rows = running_max(own, "observed", [F.col("record")], "_seen_before", ["organization"]).join(came, "organization")
    counts = stronger >= F.col("record")
    rows = rows.withColumn("_counts", F.when(counts, F.col("record"))).withColumn("_names", F.when(counts & (F.col("_seen_before").isNull() | (F.col("observed") >= F.col("_seen_before"))), F.col("record")))
    strongest = F.struct(F.col("tier"), -F.col("record"))
    aggs = [F.max_by(c, "_counts").alias(c) for c in latest]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_counts"))).alias(c) for c in known]
    return rows.groupBy("organization").agg(
        F.max_by("name", "_names").alias("name"),
        *aggs,
        F.max(F.when(F.col("_counts").isNotNull(), F.col("confidence"))).alias("confidence"),
        F.min_by("observed", "record").alias("first_seen"),
        F.max("observed").alias("last_seen"),
        F.element_at(F.array(*map(F.lit, TIERS)), F.max("tier") + 1).alias("identity_tier"),
        F.max_by("fingerprint", strongest).alias("identity_fingerprint"),
        (F.max("tier") == 0).alias("needs_review"),
    )
