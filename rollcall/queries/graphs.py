"""Dated, deep and crossed hierarchies; suppression, the data boundary and the people export over the directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..directory import PEOPLE_SQL, people
from ..functions import text as T
from ..operators import boundary as B
from ..operators import export as X
from ..operators import graph as G
from ..operators import suppression as S
from .base import query, table

#: Suppliers as a binary tree with dates, and a second parent for every seventh.
EDGES = """SELECT s_suppkey AS child, CAST(floor((s_suppkey - 1) / 2) AS BIGINT) AS parent, CASE s_suppkey % 3 WHEN 0 THEN 'part_of' WHEN 1 THEN 'reports_to' ELSE 'oversees' END AS kind,
CAST('2020-01-01' AS DATE) AS effective_from, CASE WHEN s_suppkey % 5 = 4 THEN CAST('2021-06-30' AS DATE) END AS effective_to FROM supplier WHERE s_suppkey > 0
UNION ALL SELECT s_suppkey, s_suppkey - 6, 'operated_by', CAST('2021-01-01' AS DATE), NULL FROM supplier WHERE s_suppkey > 6 AND s_suppkey % 7 = 0"""
#: A chain through all parts: as deep as it is long in steps of forty.
CHAIN = "SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part WHERE p_partkey % 40 > 0"
UP = "(WITH RECURSIVE {e}, a AS (SELECT s_suppkey AS node, s_suppkey AS ancestor, 0 AS depth FROM supplier UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON e.child = a.ancestor) SELECT node, ancestor, min(depth) AS depth FROM a GROUP BY 1, 2)"
DATED = "e AS (SELECT * FROM ({0}) WHERE effective_from <= DATE '2021-07-01' AND (effective_to IS NULL OR effective_to >= DATE '2021-07-01'))"


def _edges(spark, d):
    return _over(spark, d, EDGES, "supplier")


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


@query(f"SELECT node, ancestor, depth FROM {UP.format(e=DATED.format(EDGES))} WHERE depth > 0")
def g2_g4_hierarchy_of_a_day(spark, d):
    return G.hierarchy(_suppliers(spark, d), _edges(spark, d), as_of="2021-07-01")


@query(f"SELECT ancestor AS node, node AS descendant FROM {UP.format(e=DATED.format(EDGES))} WHERE ancestor % 4 = 1")
def g3_descendants(spark, d):
    return G.descendants(_suppliers(spark, d).filter("node % 4 = 1"), _edges(spark, d), as_of="2021-07-01")


@query(f"""SELECT p_partkey AS node FROM part WHERE EXISTS (SELECT 1 FROM part r WHERE r.p_size = 7 AND floor(r.p_partkey / 40) = floor(part.p_partkey / 40) AND r.p_partkey <= part.p_partkey)""")
def g5_deep_subtree(spark, d):
    """Chains of forty: nothing below a root is lost, however deep."""
    p = table(spark, d, "part")
    edges = p.filter("p_partkey % 40 > 0").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - 1).alias("parent"))
    return G.subtree(p.filter("p_size = 7").select(F.col("p_partkey").alias("node")), edges)


@query("""SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT (n_regionkey = 2 OR n_nationkey = 3)""")
def g6_suppressed_geography(spark, d):
    """Areas below a suppressed one are suppressed with it: regions hold nations."""
    n = table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    gone = G.subtree(spark.createDataFrame([("r2",), ("n3",)], "node string"), edges)
    c = table(spark, d, "customer").withColumn("area", F.concat(F.lit("n"), "c_nationkey"))
    return c.join(gone, F.col("area") == F.col("node"), "left_anti").select("c_custkey")


@query("""SELECT p_partkey AS node FROM part WHERE floor(p_partkey / 4) IN (SELECT floor(p_partkey / 4) FROM part GROUP BY 1 HAVING count(*) = 4) AND floor(p_partkey / 4) % 2 = 0""")
def g7_cycles(spark, d):
    """Rings of four; in every second one no day is common to all edges, so it is no cycle."""
    p = table(spark, d, "part").select("p_partkey")
    ring = F.floor(F.col("p_partkey") / 4)
    apart = ring % 2 == 1
    edges = p.select(
        F.col("p_partkey").alias("child"),
        (ring * 4 + (F.col("p_partkey") + 1) % 4).alias("parent"),
        F.when(apart & (F.col("p_partkey") % 4 == 2), "2020-07-01").otherwise("2020-01-01").cast("date").alias("effective_from"),
        F.when(apart & (F.col("p_partkey") % 4 == 0), "2020-06-30").cast("date").alias("effective_to"),
    )
    whole = p.groupBy(ring.alias("ring")).agg(F.count("*").alias("n")).filter("n = 4").select("ring")
    return G.cycles(edges.withColumn("ring", F.floor(F.col("child") / 4)).join(whole, "ring", "left_semi").drop("ring"))


_DAG = """SELECT s_suppkey AS child, floor((s_suppkey - k) / 2) AS parent, CAST('2020-01-01' AS DATE) + CAST(s_suppkey % 5 AS INT) AS effective_from, CASE WHEN s_suppkey % 3 = 0 THEN CAST('2020-01-01' AS DATE) + CAST(s_suppkey % 40 AS INT) END AS effective_to
FROM supplier, (SELECT 1 AS k UNION ALL SELECT 2) WHERE s_suppkey > 1"""
_NEW = """SELECT floor(s_suppkey / 9) AS child, s_suppkey AS parent, CAST('2020-01-01' AS DATE) + CAST(s_suppkey % 60 AS INT) AS effective_from, CAST('2020-01-03' AS DATE) + CAST(s_suppkey % 60 AS INT) AS effective_to FROM supplier WHERE s_suppkey % 4 = 3"""


@query(f"""WITH RECURSIVE x AS (SELECT CAST(child AS BIGINT) AS child, CAST(parent AS BIGINT) AS parent, effective_from AS a, coalesce(effective_to, DATE '9999-12-31') AS b FROM (SELECT * FROM ({_DAG}) UNION ALL SELECT * FROM ({_NEW})) WHERE a <= b),
w AS (SELECT CAST(child AS BIGINT) AS origin, CAST(parent AS BIGINT) AS node, effective_from AS a, effective_to AS b FROM ({_NEW}) UNION SELECT origin, x.parent, greatest(w.a, x.a), least(w.b, x.b) FROM w JOIN x ON x.child = w.node WHERE w.node <> w.origin AND greatest(w.a, x.a) <= least(w.b, x.b))
SELECT DISTINCT origin AS node FROM w WHERE node = origin""")
def g7_new_edges(spark, d):
    """New edges against a hierarchy of two parents each: which of them close a cycle that is in force on some day."""
    old = _over(spark, d, _DAG.replace("FROM supplier, (", "FROM supplier JOIN ("), "supplier").select(F.col("child"), F.col("parent").cast("long").alias("parent"), "effective_from", "effective_to")
    new = _over(spark, d, _NEW, "supplier").select(F.col("child").cast("long").alias("child"), "parent", "effective_from", "effective_to")
    return G.cycles(old, new)


@query("""SELECT s_suppkey AS child, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey // 2 <> s_suppkey THEN s_suppkey // 2 END AS parent, s_suppkey % 4 = 0 AS unresolved FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey // 2 <> s_suppkey""")
def g8_edges_from_identifiers(spark, d):
    """Parents named by identifiers: resolved to ids, edges to itself dropped, unknown ones marked."""
    s = table(spark, d, "supplier")
    owner = s.select(F.concat(F.lit("id-"), "s_suppkey").alias("identifier"), F.col("s_suppkey").alias("parent"))
    named = s.select(F.col("s_suppkey").alias("child"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("lost-"), "s_suppkey")).otherwise(F.concat(F.lit("id-"), F.floor(F.col("s_suppkey") / 2))).alias("identifier"))
    out = named.join(owner, "identifier", "left").groupBy("child").agg(F.min("parent").alias("parent"), F.max(F.col("parent").isNull()).alias("unresolved"))
    return out.filter("parent is null or parent != child")


@query(f"SELECT node, ancestor, depth FROM {UP.format(e='e AS (SELECT * FROM (' + EDGES + ') WHERE kind IN (' + repr('part_of') + ', ' + repr('reports_to') + ', ' + repr('operated_by') + '))')} WHERE depth > 0")
def g9_containing_relations(spark, d):
    return G.hierarchy(_suppliers(spark, d), G.containing(_edges(spark, d)))


# Suppression. Entries of all scopes follow from the tables; some are not yet, no longer, or not any more in force.
AT = "2024-03-01 00:00:00"
_NEVER = "CAST(NULL AS TIMESTAMP)"
ENTRIES = f"""SELECT concat('a', CAST(c_custkey AS STRING)) AS entry, 'person' AS scope, CAST(c_custkey AS STRING) AS value, CAST('2024-01-01' AS TIMESTAMP) AS effective_at,
CASE WHEN c_custkey % 2 = 0 THEN CAST('2024-03-01' AS TIMESTAMP) END AS expires_at, {_NEVER} AS revoked_at FROM customer WHERE c_custkey % 50 = 3
UNION ALL SELECT concat('b', CAST(s_suppkey AS STRING)), CASE WHEN s_suppkey % 2 = 0 THEN 'organization' ELSE 'organization_subtree' END, CAST(s_suppkey AS STRING), CAST('2024-03-01' AS TIMESTAMP), {_NEVER}, CASE WHEN s_suppkey % 3 = 2 THEN CAST('2024-02-01' AS TIMESTAMP) END FROM supplier WHERE s_suppkey % 20 IN (4, 5, 8)
UNION ALL SELECT concat('c', CAST(n_nationkey AS STRING)), 'geographic_area', concat(' N', CAST(n_nationkey AS STRING), ' '), CAST('2024-01-01' AS TIMESTAMP), CAST('2024-06-01' AS TIMESTAMP), {_NEVER} FROM nation WHERE n_nationkey % 11 = 7
UNION ALL SELECT concat('d', CAST(s_suppkey AS STRING)), 'domain', concat('@S', CAST(s_suppkey AS STRING), '.example.org'), CAST('2024-01-01' AS TIMESTAMP), {_NEVER}, {_NEVER} FROM supplier WHERE s_suppkey % 20 = 1
UNION ALL SELECT concat('e', CAST(r_regionkey AS STRING)), 'jurisdiction', CAST(r_regionkey AS STRING), CAST('2024-04-01' AS TIMESTAMP), {_NEVER}, {_NEVER} FROM region"""
#: Entries of the scopes that ENTRIES lacks, for the index alone: the export would lose everybody to the last one.
MORE = f"""{ENTRIES} UNION ALL SELECT concat('f', CAST(s_suppkey AS STRING)), 'email', concat('X', CAST(s_suppkey * 11 + 10 AS STRING), '@S', CAST(floor((s_suppkey * 11 + 10) / 15) AS BIGINT), '.example.org '), CAST('2024-01-01' AS TIMESTAMP), {_NEVER}, {_NEVER} FROM supplier
UNION ALL SELECT concat('g', CAST(r_regionkey AS STRING)), 'jurisdiction', concat('J', CAST(r_regionkey AS STRING)), CAST('2024-01-01' AS TIMESTAMP), {_NEVER}, {_NEVER} FROM region WHERE r_regionkey < 3
UNION ALL SELECT concat('h', CAST(n_nationkey AS STRING)), 'source', concat('src', CAST(n_nationkey AS STRING)), CAST('2024-01-01' AS TIMESTAMP), {_NEVER}, {_NEVER} FROM nation WHERE n_nationkey % 6 = 1
UNION ALL SELECT concat('i', CAST(r_regionkey AS STRING)), CASE r_regionkey WHEN 0 THEN 'government_level' WHEN 1 THEN 'export_purpose' ELSE 'global' END, CASE r_regionkey WHEN 0 THEN 'City' WHEN 1 THEN 'mail' END,
CAST('2024-01-01' AS TIMESTAMP), CASE WHEN r_regionkey = 4 THEN CAST('2024-02-01' AS TIMESTAMP) END, {_NEVER} FROM region"""
#: Who an entry names, by scope; suppliers in a tree of two children are organisations.
ORG_UP = "(WITH RECURSIVE a AS (SELECT s_suppkey AS node, s_suppkey AS ancestor FROM supplier UNION ALL SELECT node, CAST(floor((ancestor - 1) / 2) AS BIGINT) FROM a WHERE ancestor > 0) SELECT node, ancestor FROM a)"
def named(entries: str) -> str:
    """(person, entry, scope, rank, via) of the entries in force that name a person."""
    ranks = " ".join(f"WHEN '{scope}' THEN {k}" for k, scope in enumerate(S.SCOPES))
    return f"""SELECT person, entry, scope, rank, via FROM (SELECT *, CASE scope {ranks} END AS rank
FROM ({entries}) WHERE effective_at <= TIMESTAMP '{AT}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AT}') AND revoked_at IS NULL) e JOIN LATERAL
(SELECT person, NULL AS via FROM ({PEOPLE_SQL}) WHERE (scope = 'person' AND CAST(person AS STRING) = value) OR (scope = 'organization' AND CAST(org AS STRING) = value) OR (scope = 'geographic_area' AND 'n' || nation = lower(trim(value)))
OR (scope = 'email' AND CASE WHEN person % 2 = 0 THEN replace(address, '@', '@mail.') ELSE address END = lower(trim(value))) OR (scope = 'source' AND 'src' || nation = value) OR (scope = 'jurisdiction' AND 'j' || person % 5 = lower(value))
OR (scope = 'government_level' AND person % 3 = 1) OR (scope = 'export_purpose' AND person % 7 = 2) OR scope = 'global'
UNION ALL SELECT person, CASE WHEN ancestor = org THEN NULL ELSE CAST(ancestor AS STRING) END FROM ({PEOPLE_SQL}) JOIN {ORG_UP} u ON u.node = org WHERE scope = 'organization_subtree' AND CAST(ancestor AS STRING) = value
UNION ALL SELECT person, CASE WHEN person % 2 = 0 THEN 's' || org || '.example.org' END FROM ({PEOPLE_SQL}) WHERE address IS NOT NULL AND scope = 'domain' AND '@s' || org || '.example.org' = lower(value)) n ON TRUE"""


NAMED = named(ENTRIES)


def _over(spark, d, sql, *tables):
    """The rows that SQL gives over given tables, which no view names."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: table(spark, d, t) for t in tables})


def _entries(spark, d, sql=ENTRIES):
    return _over(spark, d, sql, "customer", "supplier", "nation", "region")


def _subjects(spark, d):
    host = F.when(F.col("person") % 2 == 0, F.replace(F.col("address"), F.lit("@"), F.lit("@mail."))).otherwise(F.col("address"))
    return people(spark, d).select("person", "org", host.alias("address"), F.array(F.concat(F.lit("n"), "nation")).alias("areas"), F.concat(F.lit("j"), F.col("person") % 5).alias("jurisdiction"),
        F.concat(F.lit("src"), "nation").alias("source"), F.when(F.col("person") % 3 == 1, "city").alias("level"), F.when(F.col("person") % 7 == 2, "Mail").alias("purpose"))


def _above(spark, d):
    """(node, ancestor) of what lies below the organisations that subtree entries name, and of nothing else."""
    s = table(spark, d, "supplier")
    edges = s.filter("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.floor((F.col("s_suppkey") - 1) / 2).alias("parent"))
    roots = _entries(spark, d).filter("scope = 'organization_subtree'").select(F.expr("try_cast(value AS bigint)").alias("node")).filter("node is not null")
    return G.descendants(roots, edges).select(F.col("descendant").alias("node"), F.col("node").alias("ancestor"))


@query(named(MORE))
def e3_suppression_matches(spark, d):
    """Entries of all eleven scopes, one of them of everybody."""
    return S.matches(_subjects(spark, d), _entries(spark, d, MORE), "person", F.lit(AT).cast("timestamp"), _above(spark, d))


@query(f"""SELECT person, min_by(scope, (rank, entry)) IS NOT NULL AS suppressed, min_by(scope, (rank, entry)) AS by_scope, min_by(entry, (rank, entry)) AS by_entry, count(DISTINCT entry) AS entries
FROM (SELECT person FROM ({PEOPLE_SQL})) LEFT JOIN ({NAMED}) USING (person) GROUP BY person""")
def n1_suppression_decisions(spark, d):
    who = _subjects(spark, d)
    found = S.matches(who, _entries(spark, d), "person", F.lit(AT).cast("timestamp"), _above(spark, d))
    return S.decided(who, found, "person").select("person", "suppressed", "by_scope", "by_entry", "entries")


@query(f"""SELECT entry, scope, lower(trim(value)) AS value FROM ({ENTRIES}) WHERE revoked_at IS NULL""")
def n2_active_entries(spark, d):
    """What is loaded: values trimmed and in lower case, revoked ones left out, the window not yet applied."""
    return _entries(spark, d).filter("revoked_at is null").select("entry", "scope", F.lower(F.trim("value")).alias("value"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE active) AS active FROM (SELECT effective_at <= TIMESTAMP '{AT}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AT}') AND revoked_at IS NULL AS active FROM ({ENTRIES}))""")
def f9_x62_suppression_window(spark, d):
    return _entries(spark, d).agg(F.count("*").alias("n"), F.count_if(S.in_force(F.lit(AT).cast("timestamp"))).alias("active"))


CHANNELS = f"""SELECT person, org, first, last, CASE WHEN person % 3 = 0 THEN NULL ELSE address END AS published, CASE WHEN person % 4 = 0 THEN 'g' || person || '@s1.example.org' END AS candidate FROM ({PEOPLE_SQL})"""
GONE = f"SELECT person FROM ({NAMED}) WHERE scope <> 'domain'"
BAD = "org % 20 = 1"  # domains that entries name
EXPORTED = f"""SELECT person, org, first, last, CASE WHEN {BAD} THEN NULL ELSE published END AS published, CASE WHEN TRUE THEN NULL ELSE candidate END AS candidate, candidate IS NOT NULL AS withheld
FROM ({CHANNELS}) WHERE person NOT IN ({GONE}) AND published IS NOT NULL AND NOT ({BAD})"""


def _exported(spark, d):
    p = people(spark, d)
    rows = p.select("person", "org", "first", "last", F.array(F.concat(F.lit("n"), "nation")).alias("areas"), F.when(F.col("person") % 3 != 0, F.col("address")).alias("published"), F.when(F.col("person") % 4 == 0, F.concat(F.lit("g"), "person", F.lit("@s1.example.org"))).alias("candidate"))
    return X.exportable(rows, _entries(spark, d), F.lit(AT).cast("timestamp"), "public", _above(spark, d))


@query(f"SELECT person, published, candidate, withheld FROM ({EXPORTED})")
def e4_people_export(spark, d):
    """Record decisions, decisions for each address, rows that keep an address, candidates taken away."""
    return _exported(spark, d).select("person", "published", "candidate", "withheld")


@query(f"""SELECT person, org, published, count(*) OVER (PARTITION BY org, published) > 1 AS conflict FROM ({EXPORTED}) QUALIFY row_number() OVER (PARTITION BY org, published ORDER BY person) = 1""")
def e4_contacts(spark, d):
    return X.contacts(_exported(spark, d).filter("published is not null"), "org", "published", [F.col("person")]).select("person", "org", "published", "conflict")


_CELL = """CASE WHEN regexp_matches({0}, '[",\\r\\n]|^ | $') THEN '"' || replace({0}, '"', '""') || '"' ELSE coalesce({0}, '') END"""


@query(f"""SELECT {_CELL.format("first")} || ',' || {_CELL.format("last")} || ',' || published || ',' || 'Org, ' || org || ',' AS value FROM ({EXPORTED})""".replace("'Org, ' || org", "'\"Org, ' || org || '\"'"))
def k2_contact_lines(spark, d):
    rows = _exported(spark, d).select(F.col("first").alias("first_name"), F.col("last").alias("last_name"), F.col("published").alias("email"), F.concat(F.lit("Org, "), F.col("org").cast("string")).alias("organization"))
    return X.lines(rows, X.CONTACTS)


#: People with several addresses and phones, each with the source that shows it; entries name sources, too.
WITH_SOURCES = f"""{ENTRIES} UNION ALL SELECT concat('s', CAST(n_nationkey AS STRING)), 'source', concat('SRC', CAST(n_nationkey AS STRING)), CAST('2024-01-01' AS TIMESTAMP), {_NEVER}, {_NEVER} FROM nation WHERE n_nationkey % 6 = 1"""
_WAYS = f"""SELECT person, org, raw_name, first, middle, last, title, nation, address IS NOT NULL AND NOT ({BAD}) AND nation % 6 <> 1 AS a1, NOT (org % 20 = 1) AND person % 25 % 6 <> 1 AS a2, nation % 6 <> 1 AS p1, person % 25 % 6 <> 1 AS p2, address,
'alt' || CASE WHEN person % 10 = 7 THEN 7 ELSE person END || '@s' || org % 20 || '.example.org' AS alt, '512-555-' || substr(CAST(10000 + person % 10000 AS VARCHAR), 2) AS phone, CASE WHEN person % 3 > 0 AND NOT ({BAD}) THEN address END AS published FROM ({PEOPLE_SQL}) WHERE person NOT IN ({GONE})"""
_MAILS = "array_to_string(list_filter([CASE WHEN a1 THEN address END, CASE WHEN a2 THEN alt END], lambda x: x IS NOT NULL), ' | ')"
_PHONES = "array_to_string(list_filter([CASE WHEN p1 THEN phone END, CASE WHEN p2 THEN phone || ' ext 2' END], lambda x: x IS NOT NULL), ' | ')"
_KNOWN = {"first_name": "first", "middle_name": "middle", "last_name": "last", "full_name_published": "raw_name", "title": "title", "organization": "'Org, ' || org", "work_phones": _PHONES, "all_published_emails": _MAILS, "published_email": "published",
          "email_classification": "CASE WHEN published IS NOT NULL THEN 'published' END", "government_level": "CASE WHEN person % 2 = 0 THEN 'city' END", "status": "'active'"}


def _released(spark, d):
    none = F.lit(None).cast("string")
    mail = lambda v, s, k: F.struct(v.alias("value"), s.alias("source"), F.lit(k).alias("classification"))
    near, far = F.concat(F.lit("src"), "nation"), F.concat(F.lit("src"), F.col("person") % 25)
    phone = F.concat(F.lit("512-555-"), F.substring((F.col("person") % 10000 + 10000).cast("string"), 2, 4))
    alt = F.concat(F.lit("alt"), F.when(F.col("person") % 10 == 7, F.lit(7)).otherwise(F.col("person")), F.lit("@s"), F.col("org") % 20, F.lit(".example.org"))
    rows = people(spark, d).select(
        "person", "org", F.col("first").alias("first_name"), F.col("middle").alias("middle_name"), F.col("last").alias("last_name"), F.col("raw_name").alias("full_name_published"), "title", F.concat(F.lit("Org, "), "org").alias("organization"),
        F.array(F.concat(F.lit("n"), "nation")).alias("areas"), F.when(F.col("person") % 3 > 0, F.col("address")).alias("published"), F.when(F.col("person") % 4 == 0, F.concat(F.lit("g"), "person", F.lit("@s1.example.org"))).alias("candidate"),
        F.when(F.col("address").isNull(), F.array(mail(alt, far, "decoded_published"))).otherwise(F.array(mail(F.col("address"), near, "published"), mail(alt, far, "decoded_published"))).alias("emails"),
        F.array(F.struct(phone.alias("value"), near.alias("source")), F.struct(F.concat(phone, F.lit(" ext 2")).alias("value"), far.alias("source"))).alias("phones"),
        F.when((F.col("person") % 3 > 0) & F.col("address").isNotNull(), "published").alias("classification"), F.when(F.col("person") % 2 == 0, "city").alias("government_level"), F.lit("active").alias("status"),
    )
    return X.released(rows, _entries(spark, d, WITH_SOURCES), F.lit(AT).cast("timestamp"), "public", _above(spark, d))


@query(f"""SELECT {" || ',' || ".join(_CELL.format(f"CAST({_KNOWN[c]} AS VARCHAR)") if c in _KNOWN else "''" for c in X.FULL)} AS value FROM ({_WAYS}) WHERE a1 OR a2 OR p1 OR p2 OR published IS NOT NULL""")
def k2_e4_full_lines(spark, d):
    """The full format: 37 columns, all addresses and phones that may leave."""
    return X.full_lines(_released(spark, d))


@query(f"""SELECT person, email, email_classification, count(DISTINCT person) OVER (PARTITION BY org, lower(email)) > 1 AS email_identity_conflict, source AS email_source_document_id, title, organization FROM
(SELECT person, org, unnest(list_filter([CASE WHEN a1 THEN {{'email': address, 'email_classification': 'published', 'source': 'src' || nation}} END, CASE WHEN a2 THEN {{'email': alt, 'email_classification': 'decoded_published', 'source': 'src' || person % 25}} END], lambda x: x IS NOT NULL), recursive := true), title, 'Org, ' || org AS organization FROM ({_WAYS}))""")
def k2_e4_staff_rows(spark, d):
    """The staff format: a row for each address, with those that several people share marked."""
    own = X.staff(_released(spark, d))
    assert own.columns[1:] == X.STAFF
    return own.select("person", "email", "email_classification", "email_identity_conflict", "email_source_document_id", "title", "organization")


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(digest, '' ORDER BY block)) AS checksum FROM (SELECT person // 4096 AS block, count(*) AS n, sha256(string_agg(sha256(published), '' ORDER BY person)) AS digest FROM ({EXPORTED}) GROUP BY 1)""")
def k3_checksum(spark, d):
    return X.checksum(_exported(spark, d).select("person", F.col("published").alias("value")), "person")


def _held(pattern: str) -> str:
    return f"regexp_matches(text, '{pattern}')"


_KINDS = {
    "government_id_number": _held(B.SSN),
    "date_of_birth": _held("(?i)" + B.LABELS["date_of_birth"]) + " AND " + _held(B.DATE),
    "financial_account": _held(B.CARD),
    "medical": _held("(?i)" + B.MEDICAL_VALUE),
    "student_information": _held("(?i)" + B.STUDENT_VALUE),
    "guardian_information": _held("(?i)" + B.GUARDIAN_VALUE),
}
#: Texts, some of which end in what a medical record would hold.
_NOTES = """CASE doc_id % 8 WHEN 0 THEN concat(text, ' Diagnosed with x.') WHEN 1 THEN concat(text, ' patient id: 7') WHEN 2 THEN concat(text, ' Medical record no. 5') WHEN 3 THEN concat(text, ' health condition: x')
WHEN 4 THEN concat(text, ' prescription for x') WHEN 5 THEN concat(text, ' disability status: x') ELSE text END"""


@query(f"""SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _KINDS.items())}], lambda x: x IS NOT NULL) AS kinds FROM (SELECT doc_id, {_NOTES} AS text FROM documents)""")
def e1_prohibited_data(spark, d):
    return table(spark, d, "documents").select("doc_id", B.prohibited("account_note", F.expr(_NOTES)).alias("kinds"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'desk 5' END AS note, 'Student Services' AS title, NULL AS home_address, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_findings FROM customer""")
def e2_boundary(spark, d):
    note = F.when(F.col("c_custkey") % 3 == 0, F.lit("ssn 123-45-6789")).otherwise(F.lit("desk 5"))
    rows = table(spark, d, "customer").select("c_custkey", note.alias("note"), F.lit("Student Services").alias("title"), F.lit("1 Main St").alias("home_address"))
    return B.bounded(rows, ["note", "title", "home_address"]).select("c_custkey", "note", "title", "home_address", F.size("findings").alias("n_findings"))


@query("""SELECT s_suppkey, substr(sha256('{"name":"' || s_name || '"}'), 1, 24) AS record_key FROM supplier""")
def e24_rekeyed_records(spark, d):
    """Keys over what the boundary left."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.lit("x").alias("spouse"))
    kept = B.bounded(rows, ["name", "spouse"])
    return kept.select("s_suppkey", T.short_hash(F.to_json(F.struct("name", "spouse")), 24).alias("record_key"))
