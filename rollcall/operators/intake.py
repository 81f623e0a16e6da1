"""Intake of records: reasons against them, routing, reconciliation, policies and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import unused


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason, in order, whose condition holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()])


def all_reasons(reasons: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))


def validated(rows: DataFrame, reasons: dict[str, Column], key: list[str], order: str, duplicate: str = "duplicate") -> DataFrame:
    """rows with reasons: all that hold, and `duplicate` for every row but the first by order among those with one key
    and no other reason. A row that is refused makes no other one a duplicate."""
    own = rows.withColumn("reasons", all_reasons(reasons))
    clean = unused(own, "clean")
    nth = F.row_number().over(Window.partitionBy(*key, clean).orderBy(order))
    again = F.when(F.col(clean) & (nth > 1), F.array(F.lit(duplicate))).otherwise(F.col("reasons"))
    return own.withColumn(clean, F.size("reasons") == 0).withColumn("reasons", again).drop(clean)


def reconciled(found: DataFrame, inventory: DataFrame, key: str, count: str) -> DataFrame:
    """(key, expected, found, state) of every key on either side: equal, short, over, missing or unexpected."""
    both = inventory.select(key, F.col(count).alias("expected")).join(found.select(key, F.col(count).alias("found")), key, "full")
    state = (
        F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("found") < F.col("expected"), "short").when(F.col("found") > F.col("expected"), "over").otherwise("equal")
    )
    return both.withColumn("state", state)


def assert_reconciled(report: DataFrame) -> None:
    wrong = report.filter("state != 'equal'").orderBy(report.columns[0]).limit(5).collect()
    if wrong:
        raise ValueError(f"sources and inventory differ: {[tuple(r) for r in wrong]}")


def matched(records: DataFrame, owners: DataFrame, record: str, identifiers: list[str], owner: str) -> DataFrame:
    """(record, owner, state): linked to the only owner of a record's identifiers, held where there are several, new
    where there is none. Null identifiers match nothing."""
    mine = records.select(record, *identifiers)
    # Of an identifier's owners the least and the greatest say all: records never meet each of them.
    low, high = unused(mine, "low"), unused(mine, "high")
    ends = owners.groupBy(*identifiers).agg(F.min(owner).alias(low), F.max(owner).alias(high))
    hits = mine.join(ends, identifiers, "left").groupBy(record).agg(F.min(low).alias(low), F.max(high).alias(high))
    one = F.col(low) == F.col(high)
    state = F.when(one, "linked").when(~one, "held").otherwise("new")
    return hits.select(record, F.when(one, F.col(low)).alias(owner), state.alias("state"))


def policy_decision(status: Column, approved: Column, fixture: Column) -> Column:
    """Whether a source may be read: prohibited never; a fixture always; allowed; review required only once approved;
    what nobody knows is denied."""
    return (
        F.when(status == "prohibited", "deny").when(fixture, "allow").when(status == "allowed", "allow").when((status == "review_required") & F.coalesce(approved, F.lit(False)), "allow").when(status == "review_required", "hold").otherwise("deny")
    )


def verdict(run_used: Column, run_budget: int, depth: Column, deepest: int, visited: Column, domain_used: Column, domain_budget: int, failures: Column, most_failures: int, excluded: Column) -> Column:
    """What stops a fetch, the first of: the run's budget, depth, a page seen before, the domain's budget, failures in a
    row, exclusion; 'fetch' if nothing does."""
    return F.coalesce(
        first_reason({
            "run_budget": run_used >= run_budget, "depth": depth > deepest, "visited": visited, "domain_budget": domain_used >= domain_budget,
            "failures": failures >= most_failures, "excluded": excluded,
        }),
        F.lit("fetch"),
    )


def complaint_matches(complaints: DataFrame, contacts: DataFrame, complaint: str, contact: str, person: str) -> DataFrame:
    """(complaint, people, state, person): the only person of a normalised contact is suppressed; with none or several
    a human has to look."""
    # A contact's people are counted once, not for each complaint that names it.
    own = complaints.select(complaint, contact).distinct()
    people = contacts.select(contact, person).distinct()
    counted = people.groupBy(contact).agg(F.count(person).alias("people"), F.min(person).alias("only"))
    named = own.groupBy(complaint).agg(F.array_sort(F.collect_set(contact)).alias("contacts"))
    single = named.filter("size(contacts) < 2").select(complaint, F.get("contacts", F.lit(0)).alias(contact))
    single = single.join(counted, contact, "left").select(complaint, F.coalesce("people", F.lit(0)).alias("people"), "only")
    # Where a complaint names several contacts, people count once over all of them; equal sets are looked up once.
    several = named.filter("size(contacts) > 1")
    each = several.select("contacts").distinct().select("contacts", F.explode("contacts").alias(contact))
    over = each.join(people, contact, "left").groupBy("contacts").agg(F.count_distinct(person).alias("people"), F.min(person).alias("only"))
    out = single.unionByName(several.join(over, "contacts").select(complaint, "people", "only"))
    one = F.col("people") == 1
    return out.select(complaint, "people", F.when(one, "suppressed").otherwise("needs_review").alias("state"), F.when(one, F.col("only")).alias(person))


def contact_key(kind: Column, value: Column) -> Column:
    """A complaint's contact in comparable form: addresses in lower case, ten digits of phones, postal ones as words."""
    low = F.lower(F.trim(value))
    digits = F.regexp_replace(low, "[^0-9]", "")
    return F.when(kind == "email", low).when(kind == "phone", F.right(digits, F.lit(10))).otherwise(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")))


def canonical_time(c: Column) -> Column:
    """An ISO time with any offset as UTC, to the second; null if it is none."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
