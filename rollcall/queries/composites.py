"""Intake, matching, policies, projects and queues, over records derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..directory import PEOPLE_SQL, people
from ..functions import emails as E
from ..functions import names as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import intake as I
from ..operators.latest import best_of
from ..operators.suppression import matches, parted
from . import graphs
from .base import query, table
from .people import KNOWN, PARTS, TITLES
from .text import sql_key


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 20000 THEN 'too_small' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_custkey % 10 = 0 THEN 'no_contact' END, CASE WHEN n > 1 AND clean THEN 'duplicate' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, clean ORDER BY o_orderkey) AS n FROM (SELECT *, NOT (o_totalprice < 20000 OR o_orderstatus = 'P' OR o_custkey % 10 = 0) AS clean FROM orders))""")
def e5_validated_bundle(spark, d):
    """All reasons against a row; duplicates only among rows that nothing else speaks against."""
    reasons = {"too_small": F.col("o_totalprice") < 20000, "open": F.col("o_orderstatus") == "P", "no_contact": F.col("o_custkey") % 10 == 0}
    return I.validated(table(spark, d, "orders"), reasons, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey", "reasons")


@query(f"""SELECT person, CASE WHEN form = 7 THEN 'no_first_name' WHEN address IS NULL THEN 'no_address' WHEN nation = 3 THEN 'outside' WHEN title = 'Wizard' THEN 'unknown_title' WHEN org % 10 = 9 THEN 'unverified_source' ELSE 'accepted' END AS outcome FROM ({PEOPLE_SQL})""")
def e6_prepared_contacts(spark, d):
    """The first reason that holds quarantines a contact."""
    own = people(spark, d).withColumn("name", N.parse(spark, F.col("raw_name")))
    reasons = {"no_first_name": F.col("name.first").isNull(), "no_address": F.col("address").isNull(), "outside": F.col("nation") == 3, "unknown_title": N.title(F.col("title"))["role"] == "other", "unverified_source": F.col("org") % 10 == 9}
    return own.select("person", F.coalesce(I.first_reason(reasons), F.lit("accepted")).alias("outcome"))


_ROLES = ", ".join(f"({raw!r}, {row[1]!r})" for raw, row in zip(TITLES.split(","), KNOWN, strict=True))


@query(f"""SELECT p.person, q.org || '|' || {sql_key("concat_ws(' ', q.last, q.first)")} AS identity_key, role, CASE WHEN p.address IS NULL THEN 'none' WHEN p.person % 2 = 0 THEN 'published' ELSE 'decoded_published' END AS kind, NULL AS note
FROM ({PEOPLE_SQL}) p JOIN ({PARTS}) q ON p.person = q.person JOIN (VALUES {_ROLES}) t(raw, role) ON raw = p.title""")
def e7_ingested_people(spark, d):
    """Boundary, name, title and address of each record in one pass."""
    from ..operators.boundary import bounded

    own = bounded(people(spark, d).withColumn("note", F.lit("SSN 123-45-6789")), ["title", "note"]).withColumn("name", N.parse(spark, F.col("raw_name")))
    t = N.tokens(F.col("name"))
    kind = F.when(F.col("address").isNull(), "none").otherwise(E.kind(F.col("address"), F.col("person") % 2 == 0, F.lit(False), E.names_person(E.local_part(F.col("address")), t)))
    return own.select("person", N.identity_key(F.col("org"), F.col("name")).alias("identity_key"), N.title(F.col("title"))["role"].alias("role"), kind.alias("kind"), "note")


@query("""WITH s AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM supplier GROUP BY 1) SELECT c_custkey, CASE WHEN n = 1 THEN id END AS s_suppkey, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'held' ELSE 'new' END AS state FROM customer LEFT JOIN s ON k = c_nationkey""")
def e9_n5_matched_records(spark, d):
    owners = table(spark, d, "supplier").select(F.col("s_nationkey").alias("identifier"), "s_suppkey")
    records = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("identifier"))
    return I.matched(records, owners, "c_custkey", ["identifier"], "s_suppkey")


@query("""SELECT s_suppkey, s_name AS name, 'N' || s_nationkey AS state, CASE WHEN s_acctbal < 0 THEN 'closed' ELSE 'open' END AS status, CAST(floor(s_acctbal) AS BIGINT) AS size, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS n_identifiers FROM supplier""")
def e10_normalized_roster(spark, d):
    """Cells of an official file as one nested record."""
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" '"), "s_name").alias("NAME"), F.concat(F.lit("n"), "s_nationkey").alias("ST"), F.format_number(F.floor("s_acctbal"), 0).alias("SIZE"), F.when(k % 2 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("ALT"))
    size = T.number(F.col("SIZE"))
    ids = F.array_compact(F.array(F.struct(F.lit("main").alias("system"), k.cast("string").alias("value")), F.when(T.cell(F.col("ALT")).isNotNull(), F.struct(F.lit("alt").alias("system"), T.cell(F.col("ALT")).alias("value")))))
    record = F.struct(T.cell(F.col("NAME")).alias("name"), F.upper(T.cell(F.col("ST"))).alias("state"), F.when(size < 0, "closed").otherwise("open").alias("status"), size.cast("long").alias("size"), ids.alias("identifiers"))
    return raw.select("s_suppkey", record.alias("r")).select("s_suppkey", "r.name", "r.state", "r.status", "r.size", F.size("r.identifiers").alias("n_identifiers"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'county' WHEN left(p_type, 1) = 'S' THEN 'special' WHEN p_size < 10 THEN 'town' ELSE 'review' END AS class, CASE WHEN p_type = 'ECONOMY' OR left(p_type, 1) = 'S' THEN 'done' WHEN p_size < 10 THEN 'queue' WHEN p_size < 30 THEN 'second' ELSE 'manual' END AS stage FROM part""")
def e11_e12_n26_classification(spark, d):
    """A decision table on kind and code, and where what it leaves open goes."""
    kind = F.coalesce(I.first_reason({"county": F.col("p_type") == "ECONOMY", "special": F.left("p_type", F.lit(1)) == "S", "town": F.col("p_size") < 10}), F.lit("review"))
    own = table(spark, d, "part").withColumn("class", kind)
    stage = F.coalesce(I.first_reason({"done": F.col("class").isin("county", "special"), "queue": F.col("class") == "town", "second": F.col("p_size") < 30}), F.lit("manual"))
    return own.select("p_partkey", "class", stage.alias("stage"))


@query("""SELECT coalesce(a.k, b.k) AS nation, b.n AS expected, a.n AS found, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'unexpected' WHEN a.n < b.n THEN 'short' WHEN a.n > b.n THEN 'over' ELSE 'equal' END AS state
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT n_nationkey AS k, CAST(4 AS BIGINT) AS n FROM nation WHERE n_nationkey < 20) b ON a.k = b.k""")
def e13_reconciled_sources(spark, d):
    found = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    inventory = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"), F.lit(4).cast("long").alias("n"))
    return I.reconciled(found, inventory, "nation", "n")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'valid' WHEN c_acctbal < 0 THEN 'invalid' ELSE 'unvalidated' END AS result FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100""")
def e15_validation_batch(spark, d):
    """The surest candidates first; those without a result stay unvalidated."""
    c = table(spark, d, "customer")
    results = c.filter("c_acctbal > 9000 or c_acctbal < 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, "valid").otherwise("invalid").alias("result"))
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey")
    return top.join(results, "c_custkey", "left").fillna("unvalidated", ["result"])


@query("""WITH p AS (SELECT c_nationkey AS k, count(*) AS n, min(c_custkey) AS id FROM customer WHERE c_acctbal > 8000 GROUP BY 1) SELECT s_suppkey, coalesce(n, 0) AS people, CASE WHEN n = 1 THEN 'suppressed' ELSE 'needs_review' END AS state, CASE WHEN n = 1 THEN id END AS person FROM supplier LEFT JOIN p ON k = s_nationkey""")
def e16_x64_n3_complaints(spark, d):
    """Complaints by phone, in another form than the one that people have."""
    kind = F.lit("phone")
    contacts = table(spark, d, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("person"), I.contact_key(kind, F.concat(F.lit("1-555-000-"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))).alias("contact"))
    complaints = table(spark, d, "supplier").select("s_suppkey", I.contact_key(kind, F.concat(F.lit("(555) 000 "), F.lpad(F.col("s_nationkey").cast("string"), 4, "0"))).alias("contact"))
    once = best_of(complaints.union(complaints), ["s_suppkey"], [F.col("contact")])  # a retry brings the same key again
    return I.complaint_matches(once, contacts, "s_suppkey", "contact", "person")


@query("""SELECT s_suppkey, coalesce(n, 0) AS candidates, first_page FROM supplier LEFT JOIN (SELECT page_id % 50 AS k, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1) ON k = s_suppkey WHERE s_suppkey % 3 = 0 AND s_suppkey > 2 ORDER BY s_suppkey LIMIT 20""")
def e17_missing_websites(spark, d):
    found = table(spark, d, "pages").groupBy((F.col("page_id") % 50).alias("s_suppkey")).agg(F.count("*").alias("candidates"), F.min("page_id").alias("first_page"))
    s = table(spark, d, "supplier").filter("s_suppkey % 3 = 0 and s_suppkey > 2").orderBy("s_suppkey").limit(20).select("s_suppkey")
    return s.join(found, "s_suppkey", "left").fillna(0, ["candidates"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'missing_website' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'no_target' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'collected'
WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'in_progress' ELSE 'not_collected' END AS outcome FROM customer""")
def e18_outcomes(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"), F.bool_or(F.col("o_orderstatus") == "P").alias("open"))
    own = table(spark, d, "customer").join(o, "c_custkey", "left")
    outcome = I.first_reason({"missing_website": F.col("c_acctbal") < 0, "no_target": F.col("done").isNull(), "collected": F.col("done"), "in_progress": F.col("open")})
    return own.select("c_custkey", F.coalesce(outcome, F.lit("not_collected")).alias("outcome"))


@query("""SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS by_region, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AS by_use FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def e19_n7_project_scope(spark, d):
    """The organisations of a project, with why each is in its scope."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("by_region"))
    used = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("by_use")).distinct()
    own = s.join(nations, "s_nationkey", "left").join(used, "s_suppkey", "left").fillna(False, ["by_region", "by_use"])
    return own.filter("by_region or by_use").select("s_suppkey", "by_region", "by_use")


@query(f"""SELECT person FROM ({PEOPLE_SQL}) WHERE title <> 'Wizard' AND address IS NOT NULL AND person NOT IN (SELECT person FROM ({graphs.NAMED}))""")
def e20_collected_contacts(spark, d):
    """Contacts that the filters leave, without those that any entry names."""
    who = graphs._subjects(spark, d)
    found = matches(who, graphs._entries(spark, d), "person", F.lit(graphs.AT).cast("timestamp"), graphs._above(spark, d))
    chosen = people(spark, d).filter("title != 'Wizard' and address is not null").select("person")
    return parted(chosen, found, "person")[0]


CANONICAL_TARGET = r"regexp_extract(url, '^[a-z]+://[^/?#]+') || '/'"


@query(f"""SELECT {CANONICAL_TARGET} AS target, substr(sha256({CANONICAL_TARGET}), 1, 32) AS url_hash, min(page_id) AS first_page, count(*) AS organizations FROM pages GROUP BY 1""")
def e21_n20_discovery_targets(spark, d):
    """One target for each canonical website, linked to all that share it."""
    own = table(spark, d, "pages").select("page_id", U.website_root(F.col("url")).alias("target"))
    return own.groupBy("target").agg(F.min("page_id").alias("first_page"), F.count("*").alias("organizations")).withColumn("url_hash", T.short_hash(F.col("target"), 32))


@query("""SELECT p_partkey, p_type = 'ECONOMY' AS teacher, CASE WHEN p_size BETWEEN 1 AND 12 THEN lpad(CAST(least(p_size, 3) AS VARCHAR), 2, '0') || '-' || lpad(CAST(greatest(p_size, 3) AS VARCHAR), 2, '0') END AS grades FROM part""")
def e22_x19_education_columns(spark, d):
    grades = F.array_sort(F.array_compact(F.transform(F.array(F.col("p_size").cast("string"), F.when(F.col("p_size") <= 12, "3rd")), T.grade)))
    span = F.when(F.size(grades) == 2, F.concat_ws("-", grades[0], grades[1]))
    return table(spark, d, "part").select("p_partkey", (F.col("p_type") == "ECONOMY").alias("teacher"), span.alias("grades"))


POLICY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'prohibited' WHEN '2-HIGH' THEN 'review_required' WHEN '3-MEDIUM' THEN 'allowed' ELSE 'unknown' END"


@query(f"""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN status = 'prohibited' THEN 'deny' WHEN o_custkey % 20 = 0 THEN 'allow' WHEN status = 'allowed' THEN 'allow' WHEN status = 'review_required' AND o_orderstatus = 'F' THEN 'allow' WHEN status = 'review_required' THEN 'hold' ELSE 'deny' END AS decision FROM (SELECT *, {POLICY} AS status FROM orders)) GROUP BY 1""")
def e23_source_policies(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.expr(POLICY))
    decision = I.policy_decision(F.col("status"), F.when(F.col("o_orderstatus") == "F", True), F.col("o_custkey") % 20 == 0)
    return o.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(f"""SELECT o_custkey AS domain, count(*) AS targets, bool_or(status = 'prohibited') AS prohibited, count(*) FILTER (WHERE status = 'review_required' AND o_orderstatus <> 'F') AS held, min(o_orderdate) FILTER (WHERE status = 'review_required' AND o_orderstatus <> 'F') AS held_since FROM (SELECT *, {POLICY} AS status FROM orders) GROUP BY 1""")
def e26_n11_domain_manifest(spark, d):
    """What each domain's targets may do, and what waits for a review since when."""
    o = table(spark, d, "orders").withColumn("status", F.expr(POLICY))
    held = I.policy_decision(F.col("status"), F.col("o_orderstatus") == "F", F.lit(False)) == "hold"
    return o.groupBy(F.col("o_custkey").alias("domain")).agg(F.count("*").alias("targets"), F.bool_or(F.col("status") == "prohibited").alias("prohibited"), F.count_if(held).alias("held"), F.min(F.when(held, F.col("o_orderdate"))).alias("held_since"))


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal > 0 GROUP BY 1 HAVING max(c_acctbal) > 9000)""")
def e25_n18_purpose_gate(spark, d):
    """Only rows whose purpose is active and not retired."""
    purposes = table(spark, d, "customer").filter("c_custkey % 2 = 0 and c_acctbal > 0").groupBy("c_mktsegment").agg((F.max("c_acctbal") > 9000).alias("active")).filter("active")
    return table(spark, d, "customer").join(purposes, "c_mktsegment", "left_semi").select("c_custkey")


@query(f"""SELECT CAST((SELECT count(*) FROM ({graphs.EXPORTED})) AS BIGINT) AS rows, (SELECT count(*) FROM ({graphs.EXPORTED}) WHERE withheld) AS withheld, (SELECT count(*) FROM ({PEOPLE_SQL})) - (SELECT count(*) FROM ({graphs.EXPORTED})) AS left_out""")
def e27_export_summary(spark, d):
    out = graphs._exported(spark, d).agg(F.count("*").alias("rows"), F.count_if("withheld").alias("withheld"))
    return out.join(people(spark, d).agg(F.count("*").alias("all_people"))).select("rows", "withheld", (F.col("all_people") - F.col("rows")).alias("left_out"))


@query(f"""SELECT domain, person, address FROM ({PEOPLE_SQL}) WHERE address IS NOT NULL AND form <> 7 AND NOT starts_with(address, 'x')""")
def n4_published_pairs(spark, d):
    own = people(spark, d).withColumn("name", N.parse(spark, F.col("raw_name")))
    return own.filter(F.col("name.first").isNotNull() & F.col("address").isNotNull() & ~F.col("address").startswith("x")).select("domain", "person", "address")


@query("""SELECT DISTINCT l_suppkey AS target, CASE WHEN l_suppkey % 2 = 0 THEN 'directory' ELSE 'website' END AS kind FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_linenumber = 7)""")
def n8_approved_run(spark, d):
    """Distinct targets without an active job."""
    li = table(spark, d, "lineitem")
    active = li.filter("l_returnflag = 'R' and l_quantity = 50 and l_linenumber = 7").select("l_suppkey").distinct()
    return li.select("l_suppkey").distinct().join(active, "l_suppkey", "left_anti").select(F.col("l_suppkey").alias("target"), F.when(F.col("l_suppkey") % 2 == 0, "directory").otherwise("website").alias("kind"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40""")
def n9_approved_batch(spark, d):
    blocked = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").join(blocked, "o_custkey", "left_anti").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(40).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""")
def n10_enqueued(spark, d):
    """In scope by two keys, not queued and not active."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sellers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    own = c.join(sellers, "c_nationkey", "left_semi").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"))
    for busy in (o.filter("o_orderstatus = 'P' and o_totalprice > 200000"), o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 300000")):
        own = own.join(busy, "c_custkey", "left_anti")
    return own.select("c_custkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a|b' WHEN s_suppkey % 3 = 1 THEN 'tx' ELSE '' END AS states, CASE WHEN s_suppkey % 3 = 2 THEN 100 ELSE 5 END AS most FROM supplier""")
def n14_normalized_filters(spark, d):
    """Filters from JSON: trimmed, each once, defaults where text is missing or broken."""
    raw = F.expr("""CASE s_suppkey % 3 WHEN 0 THEN '{"states": [" a", "b", "a "], "most": 5}' WHEN 1 THEN '{"states": ["tx", ""], "most": 5}' ELSE '{"states": [' END""")
    own = F.from_json(raw, "states array<string>, most int")
    states = F.filter(F.array_distinct(F.transform(own["states"], lambda s: F.trim(s))), lambda s: s != "")
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.array_join(states, "|"), F.lit("")).alias("states"), F.coalesce(own["most"], F.lit(100)).alias("most"))


@query("""SELECT c_mktsegment, count(*) AS selected, count(*) FILTER (WHERE c_acctbal >= 0 AND c_nationkey < 20) AS ready, count(*) FILTER (WHERE c_acctbal < 0) AS held, count(*) FILTER (WHERE c_nationkey >= 20) AS outside FROM customer GROUP BY 1""")
def n15_project_counts(spark, d):
    low, out = F.col("c_acctbal") < 0, F.col("c_nationkey") >= 20
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("selected"), F.count_if(~low & ~out).alias("ready"), F.count_if(low).alias("held"), F.count_if(out).alias("outside"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'verified' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE CASE o_orderstatus WHEN 'F' THEN 'verified' ELSE 'rejected' END END AS state, o_orderstatus = 'P' AS changed FROM orders""")
def n16_website_transitions(spark, d):
    """Only proposed candidates change; decided ones stay."""
    proposed = F.col("o_orderstatus") == "P"
    now = F.when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected")
    return table(spark, d, "orders").select("o_orderkey", F.when(proposed & (F.col("o_totalprice") > 100000), "verified").when(proposed, "rejected").otherwise(now).alias("state"), proposed.alias("changed"))


@query("""SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN 'rejected' WHEN regexp_matches(url, 'cheap-pills') THEN 'prohibited' ELSE 'approved' END AS review, sha256(html) AS snapshot FROM pages""")
def n17_policy_reviews(spark, d):
    """A review needs a text, whose hash it keeps; some domains are never approved."""
    review = I.first_reason({"rejected": F.length("html") % 3 == 0, "prohibited": F.contains(U.host_of(F.col("url")), F.lit("cheap-pills"))})
    return table(spark, d, "pages").select("page_id", F.coalesce(review, F.lit("approved")).alias("review"), F.sha2("html", 256).alias("snapshot"))


@query("""SELECT event_id, CASE WHEN all_before >= 800 THEN 'run_budget' WHEN value > 300 THEN 'depth' WHEN seen < event_id THEN 'visited' WHEN mine_before >= 40 THEN 'domain_budget' WHEN event_type = 'error' THEN 'excluded' ELSE 'fetch' END AS verdict
FROM (SELECT *, event_id AS all_before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS mine_before, min(event_id) OVER (PARTITION BY user_id, props) AS seen FROM events)""")
def n21_t1_guard_verdicts(spark, d):
    """What stops each fetch of a page log, in a fixed order of guards; what was visited is state by key."""
    user = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events")
    visited = F.min("event_id").over(Window.partitionBy("user_id", "props")) < F.col("event_id")
    own = I.verdict(F.col("event_id"), 800, F.col("value"), 300, visited, F.row_number().over(user) - 1, 40, F.lit(0), 1, F.col("event_type") == "error")
    return e.select("event_id", own.alias("verdict"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '#' || substr(sha256(html), 1, 32) END AS identity FROM pages""")
def n22_pagination_identity(spark, d):
    """A page's URL, and its body's hash where the same URL serves several pages."""
    return table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#"), T.short_hash(F.col("html"), 32))).alias("identity"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 100) THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'complete' END AS outcome, count(*) AS pages, count(*) FILTER (WHERE event_type = 'click') AS records FROM events GROUP BY 1""")
def n23_run_outcomes(spark, d):
    bad = F.col("event_type") == "error"
    outcome = F.when(F.bool_or(bad & (F.col("value") > 100)), "failed").when(F.bool_or(bad), "partial").otherwise("complete")
    return table(spark, d, "events").groupBy("user_id").agg(outcome.alias("outcome"), F.count("*").alias("pages"), F.count_if(F.col("event_type") == "click").alias("records"))


@query("""SELECT p_brand, count(DISTINCT (p_type, p_size)) > 1 AS inconsistent, count(*) > count(DISTINCT p_name) AS duplicates, min(p_partkey) AS first_seen FROM part GROUP BY 1""")
def n24_roster_errors(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg((F.count_distinct(F.struct("p_type", "p_size")) > 1).alias("inconsistent"), (F.count("*") > F.count_distinct("p_name")).alias("duplicates"), F.min("p_partkey").alias("first_seen"))


@query("""SELECT s_suppkey AS child, s_suppkey // 2 AS parent, 'part_of' AS kind, CASE WHEN s_suppkey % 2 = 0 THEN '{"name":"' || s_name || '"}' ELSE '{"name":"' || s_name || '","zip":"0' || s_suppkey || '-1"}' END AS compact FROM supplier WHERE s_suppkey > 0""")
def n25_relationships_and_compaction(spark, d):
    """Edges emitted from rows; maps without their empty values; postal parts joined."""
    s = table(spark, d, "supplier").filter("s_suppkey > 0")
    whole = F.when(F.col("s_suppkey") % 2 == 1, F.concat_ws("-", F.concat(F.lit("0"), "s_suppkey"), F.lit("1"))).otherwise("")
    own = F.map_filter(F.create_map(F.lit("name"), F.col("s_name"), F.lit("zip"), whole), lambda k, v: v != "")
    return s.select(F.col("s_suppkey").alias("child"), F.floor(F.col("s_suppkey") / 2).alias("parent"), F.lit("part_of").alias("kind"), F.to_json(own).alias("compact"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' WHEN c_nationkey < 10 THEN 'ready' ELSE 'staged' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'exact' WHEN c_nationkey < 15 THEN 'prefix' ELSE 'none' END AS found FROM customer""")
def n27_staged_records(spark, d):
    """A status by rule; the inventory is looked up by the whole key, else by what stands before its colon."""
    c = table(spark, d, "customer").withColumn("key", F.concat(F.lit("n"), "c_nationkey", F.lit(":"), "c_custkey"))
    exact = c.filter("c_custkey % 2 = 0").select("key", F.lit(True).alias("whole"))
    prefix = table(spark, d, "nation").filter("n_nationkey < 15").select(F.concat(F.lit("n"), "n_nationkey").alias("head"), F.lit(True).alias("part"))
    own = c.withColumn("head", F.substring_index("key", ":", 1)).join(exact, "key", "left").join(prefix, "head", "left")
    status = I.first_reason({"blocked": F.col("c_acctbal") < 0, "ready": F.col("c_nationkey") < 10})
    return own.select("c_custkey", F.coalesce(status, F.lit("staged")).alias("status"), F.when(F.col("whole"), "exact").when(F.col("part"), "prefix").otherwise("none").alias("found"))


@query("""SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49) AS covered, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AS targets FROM supplier""")
def n28_uncovered_campuses(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("covered"), F.count_distinct("l_partkey").alias("targets"))
    return table(spark, d, "supplier").select("s_suppkey").join(li, "s_suppkey", "left").fillna(False, ["covered"]).fillna(0, ["targets"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '2024' END AS year FROM customer""")
def n29_whitelisted_fields(spark, d):
    """Only named fields that match their pattern, of at most 500 characters, are taken from a map."""
    rules = {"name": r"^Customer#\d+$", "year": r"^\d{4}$"}
    c = table(spark, d, "customer")
    own = F.create_map(F.lit("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.col("c_name")), F.lit("year"), F.when(F.col("c_custkey") % 4 == 0, F.repeat(F.lit("9"), 600)).otherwise("2024"), F.lit("ssn"), F.lit("123"))
    taken = [F.when(own[k].rlike(p) & (F.length(own[k]) <= 500), own[k]).alias(k) for k, p in rules.items()]
    return c.select("c_custkey", *taken)


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 11 <> 0) AS rows, bool_or(o_totalprice < 2000 AND o_orderkey % 11 <> 0) AS refused FROM orders GROUP BY 1""")
def n31_n32_preflight(spark, d):
    """A bundle is taken whole or not at all; declared exclusions don't count."""
    o = table(spark, d, "orders").filter("o_orderkey % 11 != 0")
    own = o.groupBy("o_custkey").agg(F.count("*").alias("rows"), F.bool_or(F.col("o_totalprice") < 2000).alias("refused"))
    return table(spark, d, "orders").select("o_custkey").distinct().join(own, "o_custkey", "left").fillna(0, ["rows"]).fillna(False, ["refused"])


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS utc, NULL AS bad FROM events""")
def n33_utc_times(spark, d):
    stamp = F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return table(spark, d, "events").select("event_id", I.canonical_time(stamp).alias("utc"), I.canonical_time(F.lit("soon")).alias("bad"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a' || p_partkey WHEN p_size % 3 = 1 THEN 'b' ELSE NULL END AS field, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS number FROM part""")
def x67_n37_aliases(spark, d):
    """The first of a field's aliases that holds anything; numbers in any notation."""
    k = F.col("p_size") % 3
    json_ = F.to_json(F.struct(F.when(k == 0, F.concat(F.lit("a"), "p_partkey")).alias("fullName"), F.when(k == 1, F.lit(" b ")).otherwise(F.when(k == 0, F.lit("late"))).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("size")))
    get = lambda p: T.cell(F.get_json_object(json_, p))
    return table(spark, d, "part").select("p_partkey", F.coalesce(get("$.fullName"), get("$.name")).alias("field"), F.get_json_object(json_, "$.size").try_cast("double").alias("number"))


@query("""SELECT s_suppkey, 'springfield-' || s_suppkey AS district, 'lincoln-elementary-' || s_suppkey AS school FROM supplier""")
def x20_education_names(spark, d):
    district = F.concat(F.lit("SPRINGFIELD "), "s_suppkey", F.lit(" I.S.D."))
    school = F.concat(F.lit("Lincoln El "), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", T.organization_key(district, ["ISD", "CISD", "Independent School District"]).alias("district"), T.key_of(F.regexp_replace(school, r"(?i)\b(?:el|elem)\b\.?", "Elementary")).alias("school"))


SECTORS = [
    {"sectors": ["school"], "levels": [], "rules": [(r"\bprincipal\b", "school_leader", "director", 0.9), (r"\b(teacher|coach)\b", "teacher", "staff", 0.9)]},
    {"sectors": [], "levels": ["federal"], "rules": [(r"\bagent\b", "federal_agent", "staff", 0.9)]},
    {"sectors": [], "levels": [], "rules": [(r"\bdirector\b", "department_head", "director", 0.7)]},
]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'teacher' ELSE 'other' END ELSE CASE c_custkey % 3 WHEN 0 THEN 'federal_agent' ELSE 'department_head' END END AS role FROM customer""")
def x16_x17_scoped_rules(spark, d):
    """Rules of the packs whose sector and level a row has, its own before the general ones."""
    from ..functions.vocabulary import by_scope

    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "Math Teacher").when(k % 2 == 0, "Agent").when(k % 3 == 0, "Special Agent").otherwise("Director")
    sector, level = F.when(k % 2 == 0, "school").otherwise("city"), F.when(k % 2 == 0, "local").otherwise("federal")
    role = by_scope(sector, level, SECTORS, [("school", "local"), ("city", "federal")], lambda rules: N.title(raw, rules=rules)["role"])
    return table(spark, d, "customer").select("c_custkey", role.alias("role"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS exact, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS tokens FROM part""")
def x21_exact_keys(spark, d):
    """Names in one case with plain letters and single blanks, and their words."""
    full = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF21 + k) for k in range(26)))  # full-width capitals
    exact = F.lower(T.without_marks(T.collapse_whitespace(full)))
    return table(spark, d, "part").select("p_partkey", exact.alias("exact"), F.array_sort(F.array_distinct(F.split(exact, " "))).alias("tokens"))


@query("""SELECT event_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, coalesce(CAST(user_id AS VARCHAR), ''))) AS hash FROM events""")
def x63_audit_hashes(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce(F.col("user_id").cast("string"), F.lit(""))), 256).alias("hash"))


@query("""SELECT s_suppkey, s_nationkey, 'new' AS state FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, s_nationkey, 'known' FROM supplier WHERE s_suppkey % 2 = 0""")
def n6_n30_locations(spark, d):
    """Locations are appended; those already there for their owner are left out, nulls equal."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(None).cast("string").alias("street"))
    known = s.filter("s_suppkey % 2 = 0")
    k, a = known.alias("k"), s.alias("a")
    same = (F.col("k.s_suppkey") == F.col("a.s_suppkey")) & F.col("k.s_nationkey").eqNullSafe(F.col("a.s_nationkey")) & F.col("k.street").eqNullSafe(F.col("a.street"))
    new = a.join(k, same, "left_anti")
    return new.select("s_suppkey", "s_nationkey", F.lit("new").alias("state")).union(known.select("s_suppkey", "s_nationkey", F.lit("known").alias("state")))


@query("""SELECT sha256(html) AS content, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1""")
def n40_document_cache(spark, d):
    """Pages with one content are read once, also those that list nobody."""
    return table(spark, d, "pages").groupBy(F.sha2("html", 256).alias("content")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))
