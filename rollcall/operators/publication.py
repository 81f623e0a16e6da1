"""Staged records published as organisations: matched, held, linked, with identifiers, observations and locations, at once.

A record has: id (long, unique), status, source, record_key, type, level, name, name_key, website_raw, website, domain,
jurisdiction, review_reason, identifiers (array<struct<system, state, value>>), location (struct<line1, line2, city, state,
postal>), document, version, seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import folder, written
from .store import Change, Store

READY = ("ready_to_import", "classification_hold")
KEY = ["system", "state", "value"]
SEVERAL, CLASSIFIED, CONTESTED = "identifiers of several organisations", "an exact match of another classification", "an identifier that several organisations claim"
_CLASS = ["type", "level", "jurisdiction"]
_WEBSITE = ["website", "domain", "jurisdiction"]


def _same_identifier(a: str, b: str):
    return (F.col(f"{a}.system") == F.col(f"{b}.system")) & F.col(f"{a}.state").eqNullSafe(F.col(f"{b}.state")) & (F.col(f"{a}.value") == F.col(f"{b}.value"))


def linked(records: DataFrame, identifiers: DataFrame | None, organizations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ready records with an identifier, with organization and hold (why it must wait, null if it needn't), and their
    identifiers (id, place, system, state, value).

    The only owner of a record's identifiers is its organisation. A record whose identifiers nobody owns founds one, the
    smallest id of those with the same first identifier. Held are records whose identifiers several organisations own,
    those whose organisation has another type, level or jurisdiction, and all that claim one identifier for different organisations. Counts and joins by identifier; no pairs.
    """
    ready = records.filter(F.col("status").isin(*READY) & (F.size("identifiers") > 0))
    each = ready.select("id", F.posexplode("identifiers").alias("place", "i")).select("id", "place", "i.system", F.nullif("i.state", F.lit("")).alias("state"), "i.value")
    each = written(each, folder(records.sparkSession, "identifiers"))
    first = each.filter("place = 0").alias("f")
    founders = each.filter("place = 0").groupBy(*KEY).agg(F.min("id").alias("founder")).alias("g")
    own = first.join(founders, _same_identifier("f", "g")).select("f.id", "founder")
    if identifiers is not None:
        owners = each.alias("e").join(identifiers.select(*KEY, "organization").alias("k"), _same_identifier("e", "k")).groupBy("e.id").agg(F.count_distinct("organization").alias("owners"), F.min("organization").alias("owner"))
        own = own.join(owners, "id", "left")
    else:
        own = own.withColumn("owners", F.lit(None).cast("long")).withColumn("owner", F.lit(None).cast("long"))
    own = own.select("id", F.coalesce("owner", "founder").alias("organization"), F.when(F.col("owners") > 1, SEVERAL).alias("hold"))
    if organizations is not None:
        there = organizations.select("organization", *[F.col(c).alias(f"{c}_there") for c in _CLASS])
        mine = ready.select("id", *_CLASS).join(own.filter("hold is null"), "id").join(there, "organization")
        other = mine.filter(" or ".join(f"{c} != {c}_there" for c in _CLASS)).select("id", F.lit(CLASSIFIED).alias("other"))
        own = own.join(other, "id", "left").select("id", "organization", F.coalesce("hold", "other").alias("hold"))
    claims = each.join(own.filter("hold is null"), "id").groupBy(*KEY).agg(F.count_distinct("organization").alias("n")).filter("n > 1").alias("c")
    contested = each.alias("e").join(claims, _same_identifier("e", "c")).select("e.id").distinct().withColumn("contested", F.lit(True))
    own = own.join(contested, "id", "left").select("id", "organization", F.coalesce("hold", F.when(F.col("contested"), CONTESTED)).alias("hold"))
    return ready.join(own, "id"), each


def _organizations(rows: DataFrame) -> DataFrame:
    """What an organisation was founded with stays; gaps are filled; windows and confidence widen."""
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in _WEBSITE]
    frozen = [F.min_by(c, "ord").alias(c) for c in ("name", "name_key", "type", "level", "document")]
    return rows.groupBy("organization").agg(*frozen, *known, F.max("confidence").alias("confidence"), F.min_by("first_seen", "ord").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("ord").alias("ord"))


def _identifiers(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.min_by("organization", "ord").alias("organization"), F.bool_or("is_primary").alias("is_primary"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("ord").alias("ord"))


def _once(*keys: str):
    """The first row of each key stays."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("own")).select(*[F.col(c) if c in keys else F.col(f"own.{c}").alias(c) for c in rows.columns])

    return fold


def _latest(rows: DataFrame) -> DataFrame:
    """Statuses: the last one, but imported for ever."""
    last = F.struct(F.when(F.col("status") == "imported", 1).otherwise(0), "batch")
    return rows.groupBy("id").agg(F.max_by(F.struct("status", "organization", "reason"), last).alias("own"), F.max("batch").alias("batch")).select("id", "own.*", "batch")


def publish(store: Store, records: DataFrame, batch: int) -> Change:
    """Publishes a batch of records and commits all tables at once: organizations, identifiers, observations, locations
    and the records' statuses. All checks come before the commit; a run that stops leaves what was there."""
    spark = records.sparkSession
    rows = written(records, folder(spark, "staged"))
    found, each = linked(rows, store.read("identifiers"), store.read("organizations"))
    found = written(found, folder(spark, "linked"))
    fine = found.filter("hold is null")
    change = store.begin()
    ord_ = F.lit(batch << 48) + F.col("id")
    change.merge("organizations", fine.select("organization", "name", "name_key", "type", "level", "document", *_WEBSITE, F.lit(1.0).alias("confidence"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), ord_.alias("ord")), ["organization"], _organizations)
    # The first identifier of the record that founds an organisation is its primary one.
    has = store.read("identifiers")
    named = each.join(fine.select("id", "organization", "seen"), "id")
    primary = named.filter("place = 0").groupBy("organization").agg(F.min("id").alias("chief"))
    if has is not None:
        primary = primary.join(has.filter("is_primary").select("organization").distinct(), "organization", "left_anti")
    named = named.join(primary, "organization", "left").withColumn("is_primary", (F.col("place") == 0) & F.col("id").eqNullSafe(F.col("chief")))
    change.merge("identifiers", named.select(*KEY, "organization", "is_primary", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), ord_.alias("ord")), KEY, _identifiers)
    key = F.concat_ws(":", "source", "record_key")
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(raw).alias("value_raw"), F.col(v).alias("value")) for f, raw, v in (("name", "name", "name_key"), ("website_url", "website_raw", "website"))])
    seen = fine.select("version", key.alias("record_key"), "organization", ord_.alias("ord"), F.explode(values).alias("o")).select("version", "record_key", "organization", "ord", "o.*").filter("value_raw is not null")
    change.merge("observations", seen, ["version", "record_key", "field"], _once("version", "record_key", "field"))
    parts = ["line1", "line2", "city", "state", "postal"]
    place = fine.select("organization", "document", *[F.nullif(f"location.{c}", F.lit("")).alias(c) for c in parts], ord_.alias("ord")).filter(F.coalesce(*parts).isNotNull())
    change.merge("locations", place, ["organization", "document", *parts], _once("organization", "document", *parts))
    status = F.when(F.col("hold").isNotNull(), "reconciliation_hold").when(F.col("level").isNull() | F.col("review_reason").isNotNull(), "classification_hold").otherwise("imported")
    reason = F.nullif(F.concat_ws("; ", F.nullif("review_reason", F.lit("")), "hold"), F.lit(""))
    done = found.select("id", status.alias("status"), F.when(F.col("hold").isNull(), F.col("organization")).alias("organization"), reason.alias("reason"), F.lit(batch).alias("batch"))
    other = rows.join(found, "id", "left_anti").select("id", "status", F.lit(None).cast("long").alias("organization"), F.col("review_reason").alias("reason"), F.lit(batch).alias("batch"))
    change.merge("records", done.union(other), ["id"], _latest)
    change.commit()
    return change
