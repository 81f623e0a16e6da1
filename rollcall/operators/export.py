"""The people export: decisions by record and by channel, rows that keep a channel, published columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks import csv_cell
from .suppression import matches, parted

# The columns of the three formats, in the order of their files.
CONTACTS = ["first_name", "last_name", "email", "organization", "source_page"]
FULL = (
    "first_name middle_name last_name full_name_published title title_normalized role_category job_family seniority specialty department organization "
    "organization_website organization_type parent_organization government_level sector jurisdiction duty_location_city duty_location_county "
    "duty_location_state work_phones all_published_emails published_email inferred_email_candidate email_classification email_validation_status "
    "inference_confidence source_url source_type first_seen_at last_seen_at crawl_run_id extraction_method confidence assignment_status status"
).split()
STAFF = (
    "first_name middle_name last_name full_name_published title title_normalized department organization parent_organization organization_website email "
    "email_classification email_validation_status email_obfuscation_kind email_identity_conflict role_category job_family seniority specialty "
    "role_category_flag grade_range_published location_published duty_location_city duty_location_county duty_location_state email_source_url "
    "email_source_type email_source_document_id email_source_version email_source_retrieved_at email_first_seen_at email_last_seen_at "
    "assignment_first_seen_at assignment_last_seen_at crawl_run_id extraction_method confidence import_source_dataset import_source_file "
    "import_source_line import_qa_identity_method email_source_description"
).split()


def exportable(people: DataFrame, entries: DataFrame, at: Column, purpose: str, ancestors: DataFrame | None = None) -> DataFrame:
    """people (person, org, published, candidate, and other subject columns) that may be exported: a record that any
    scope but an address names goes; a named address goes alone, and with the published one its class; a row stays
    while one address is left. withheld says whether the candidate was taken away."""
    subjects = people.withColumn("purpose", F.lit(purpose))
    records = subjects.drop("published", "candidate", "address")
    allowed, _ = parted(subjects, matches(records, entries, "person", at, ancestors), "person")
    for channel in ("published", "candidate"):
        own = allowed.filter(F.col(channel).isNotNull()).select("person", F.col(channel).alias("address"))
        named = matches(own, entries.filter(F.col("scope").isin("email", "domain")), "person", at).select("person").distinct()
        allowed = allowed.join(named.withColumn(f"{channel}_named", F.lit(True)), "person", "left")
        allowed = allowed.withColumn(f"{channel}_named", F.coalesce(f"{channel}_named", F.lit(False)) & F.col(channel).isNotNull())
    out = allowed.withColumn("withheld", F.col("candidate_named"))
    if "classification" in people.columns:
        out = out.withColumn("classification", F.when(~F.col("published_named"), F.col("classification")))
    for channel in ("published", "candidate"):
        out = out.withColumn(channel, F.when(~F.col(f"{channel}_named"), F.col(channel))).drop(f"{channel}_named")
    return out.filter("published is not null or candidate is not null").drop("purpose")


def contacts(rows: DataFrame, org: str, address: str, order: list[Column]) -> DataFrame:
    """One row for each organisation and address, the first by order; conflict says that several people share it."""
    from .latest import best_of

    own = rows.withColumn("contact_key", F.lower(address))
    shared = own.groupBy(org, "contact_key").agg((F.count_distinct("person") > 1).alias("conflict"))
    return best_of(own, [org, "contact_key"], order).join(shared, [org, "contact_key"]).drop("contact_key")


def lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value): the lines of a file of these columns; columns that rows don't have are empty."""
    cells = [csv_cell(F.col(c)) if c in rows.columns else F.lit("") for c in columns]
    return rows.select(F.concat_ws(",", *cells).alias("value"))


def checksum(rows: DataFrame, order: str, value: str = "value") -> DataFrame:
    """(rows, checksum): SHA-256 over the digests of all lines in order. Lines are folded to digests where they lie, and
    digests in blocks of order // 4096, so that no task holds a whole file."""
    own = rows.select(F.floor(F.col(order) / 4096).alias("block"), F.col(order).alias("at"), F.sha2(value, 256).alias("line"))
    blocks = own.groupBy("block").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), ""), 256).alias("digest"))
    return blocks.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x.digest), ""), 256).alias("checksum"))


def released(people: DataFrame, entries: DataFrame, at: Column, purpose: str, ancestors: DataFrame | None = None) -> DataFrame:
    """people (person unique, org, published, candidate, emails: array<struct<value, source, ...>>, phones: array<struct<value,
    source, ...>>, and other subject columns) as they may leave: a record that any scope but an address or its own channels' sources
    names goes; of the others each address and phone is decided for itself, by its domain, address and source; a row stays
    while anything to reach the person by is left. Null arrays are empty."""
    own = people.withColumns({c: F.coalesce(c, F.array().cast(people.schema[c].dataType)) for c in ("emails", "phones")}).withColumn("purpose", F.lit(purpose))
    allowed, _ = parted(own, matches(own.drop("published", "candidate", "emails", "phones", "address"), entries, "person", at, ancestors), "person")
    channel = lambda kind, k, value, source: F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("k"), value.alias("address"), source.alias("source"))
    none, first = F.lit(None).cast("string"), F.lit(0)
    every = F.concat(
        F.array(channel("published", first, F.col("published"), none), channel("candidate", first, F.col("candidate"), none)),
        F.transform("emails", lambda e, k: channel("email", k, e["value"], e["source"])),
        F.transform("phones", lambda e, k: channel("phone", k, none, e["source"])),
    )
    each = allowed.select("person", F.explode(every).alias("c")).select(F.struct("person", "c.kind", "c.k").alias("channel"), "c.address", "c.source")
    named = matches(each, entries.filter(F.col("scope").isin("email", "domain", "source")), "channel", at).select("channel").distinct()
    gone = named.groupBy(F.col("channel.person").alias("person")).agg(F.collect_set(F.concat_ws(":", "channel.kind", "channel.k")).alias("gone"))
    left = allowed.join(gone, "person", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    stays = lambda kind, k: ~F.array_contains("gone", F.concat(F.lit(f"{kind}:"), k.cast("string")))
    out = {"emails": F.filter("emails", lambda e, k: stays("email", k)), "phones": F.filter("phones", lambda e, k: stays("phone", k)), "withheld": ~stays("candidate", first) & F.col("candidate").isNotNull()}
    out |= {c: F.when(stays(c, first), F.col(c)) for c in ("published", "candidate")}
    if "classification" in people.columns:
        out["classification"] = F.when(stays("published", first), F.col("classification"))
    left = left.withColumns(out)
    return left.filter(F.coalesce("published", "candidate").isNotNull() | (F.size("emails") > 0) | (F.size("phones") > 0)).drop("gone", "purpose")


def full_lines(rows: DataFrame) -> DataFrame:
    """(value): a line of the FULL format for each released row; columns that rows don't have are empty."""
    joined = lambda c: F.nullif(F.array_join(F.transform(c, lambda e: e["value"]), " | "), F.lit(""))
    return lines(rows.withColumns({"work_phones": joined("phones"), "all_published_emails": joined("emails"), "published_email": F.col("published"), "inferred_email_candidate": F.col("candidate"), "email_classification": F.col("classification") if "classification" in rows.columns else F.lit(None)}), FULL)


def staff(rows: DataFrame, flag: str | None = None) -> DataFrame:
    """A row for each person, organisation and address of released rows, the first of equal ones, with the columns of STAFF
    that rows and their emails' structs have: an email's own (source, class, window) before the row's.
    email_identity_conflict says that several people of an organisation show the address; role_category_flag whether the
    role is `flag`."""
    from .latest import best_of

    own = rows.select("*", F.posexplode("emails").alias("nth", "e")).withColumn("contact_key", F.lower("e.value"))
    shared = own.groupBy("org", "contact_key").agg((F.count_distinct("person") > 1).alias("shared"))
    own = best_of(own, ["person", "org", "contact_key"], [F.col("nth")]).join(shared, ["org", "contact_key"])
    has = {f.name for f in rows.schema["emails"].dataType.elementType.fields}
    given = lambda name: F.col(f"e.{name}") if name in has else F.lit(None)
    row = lambda name: F.col(name) if name in rows.columns else F.lit(None)
    mail = {"email": "value", "email_classification": "classification", "email_validation_status": "validation", "email_obfuscation_kind": "obfuscation", "email_source_url": "source_url", "email_source_document_id": "source", "email_first_seen_at": "first_seen", "email_last_seen_at": "last_seen"}
    out = {c: given(c) for c in STAFF if c not in rows.columns} | {c: F.coalesce(given(c), row(c)) for c in STAFF if c in rows.columns}
    out |= {c: given(name) for c, name in mail.items()}
    out |= {"email_identity_conflict": F.col("shared") | (F.coalesce(given("conflict"), F.lit(False)) if "conflict" in has else F.lit(False)), "role_category_flag": F.lit(None) if flag is None else row("role_category").eqNullSafe(F.lit(flag))}
    out |= {"assignment_first_seen_at": row("first_seen_at"), "assignment_last_seen_at": row("last_seen_at")}
    return own.select("person", *[out[c].alias(c) for c in STAFF])
