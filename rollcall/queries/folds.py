"""Merge folds over arrivals: order lines, orders and events as observations of orders, customers and users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.latest import address_class, best_of, conflicts, first_known, folded_records, last_known, merged, versions
from ..operators.runs import consecutive, first_breaks, within_spending
from .base import query, table

#: Observations of suppliers: order lines in order of arrival.
OBSERVED = """SELECT l_suppkey AS supplier, l_returnflag AS flag, CAST(l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS BIGINT) AS arrival, l_shipdate AS seen,
CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('t', CAST(l_partkey AS STRING)) END AS title, CAST(l_discount AS DOUBLE) AS confidence, concat(l_linestatus, CAST(l_linenumber AS STRING)) AS method FROM lineitem"""


def _observed(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("rollcall_lineitem")
    return spark.sql(OBSERVED.replace("FROM lineitem", "FROM rollcall_lineitem"))


# Arrivals that share a number would make the order open; sums of ties are told apart by all columns.
UNIQUE = f"(SELECT *, row_number() OVER (PARTITION BY supplier, arrival ORDER BY seen, method, confidence) AS nth FROM ({OBSERVED}) QUALIFY nth = 1)"


def _once(spark, d):
    return best_of(_observed(spark, d), ["supplier", "arrival"], [F.col("seen"), F.col("method"), F.col("confidence")])


@query(f"""SELECT supplier, arg_max(title, (length(title), -arrival)) FILTER (WHERE title IS NOT NULL) AS title, arg_min(method, arrival) AS method, max(confidence) AS confidence, min(seen) AS first_seen, max(seen) AS last_seen FROM {UNIQUE} GROUP BY 1""")
def m1_people_fold(spark, d):
    """The longest name, the first on ties; how it was found stays as at first; the window widens."""
    o = _once(spark, d)
    return merged(o, ["supplier"], "arrival", longest=["title"], frozen=["method"], high=["confidence", "seen"], low=["seen"])


@query(f"""SELECT supplier, flag, arg_max(title, arrival) FILTER (WHERE title IS NOT NULL) AS title, arg_max(method, arrival) AS method, max(confidence) AS confidence, min(seen) AS first_seen, max(seen) AS last_seen FROM {UNIQUE} GROUP BY 1, 2""")
def m2_assignments_fold(spark, d):
    return merged(_once(spark, d), ["supplier", "flag"], "arrival", last=["title"], latest=["method"], high=["confidence", "seen"], low=["seen"])


@query(f"""SELECT supplier, title, CASE WHEN bool_or(kind = 'published') THEN 'published' ELSE arg_min(kind, arrival) END AS kind, coalesce(arg_max(method, arrival) FILTER (WHERE kind = 'published'), arg_min(method, arrival)) AS obfuscation,
max(seen) AS last_seen FROM (SELECT *, CASE flag WHEN 'A' THEN 'published' WHEN 'R' THEN 'decoded_published' ELSE 'general_inbox' END AS kind FROM {UNIQUE}) GROUP BY 1, 2""")
def m3_addresses_fold(spark, d):
    """Null titles are one key; 'published' wins for ever."""
    o = _once(spark, d).withColumn("kind", F.expr("CASE flag WHEN 'A' THEN 'published' WHEN 'R' THEN 'decoded_published' ELSE 'general_inbox' END"))
    shown = F.max_by("method", F.when(F.col("kind") == "published", F.col("arrival")))
    return o.groupBy("supplier", "title").agg(address_class("kind", "arrival").alias("kind"), F.coalesce(shown, F.min_by("method", "arrival")).alias("obfuscation"), F.max("seen").alias("last_seen"))


@query(f"""SELECT supplier, method, arg_max(title, arrival) FILTER (WHERE title IS NOT NULL) AS title, max(confidence) AS confidence, arg_min(seen, arrival) AS first_seen, max(seen) AS last_seen FROM {UNIQUE} GROUP BY 1, 2""")
def m4_contact_points_fold(spark, d):
    """Only the later end of the window moves."""
    o = _once(spark, d)
    return o.groupBy("supplier", "method").agg(last_known("title", F.col("arrival")).alias("title"), F.max("confidence").alias("confidence"), F.min_by("seen", "arrival").alias("first_seen"), F.max("seen").alias("last_seen"))


@query("""SELECT user_id, coalesce(content, 'unhashed:' || event_id) AS content, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS version FROM
(SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS content FROM events) GROUP BY user_id, coalesce(content, 'unhashed:' || event_id)""")
def m5_document_versions(spark, d):
    own = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("content"))
    return versions(own, "user_id", "content", "event_id").select("user_id", "content", "version")


@query("""SELECT o_custkey, o_orderdate, count(DISTINCT (o_orderstatus, o_orderpriority)) AS versions FROM orders GROUP BY 1, 2 HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1""")
def m6_conflicting_observations(spark, d):
    return conflicts(table(spark, d, "orders"), ["o_custkey", "o_orderdate"], ["o_orderstatus", "o_orderpriority"])


TIER = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END"


@query(f"""SELECT o_custkey, min({TIER}) AS tier, arg_max(o_orderstatus, (-({TIER}), o_orderkey)) AS status, max(o_orderdate) AS last_seen FROM orders GROUP BY 1""")
def m7_strongest_tier(spark, d):
    """Fields change only by an arrival of an equal or stronger tier: the last of the strongest remains."""
    tier = F.expr(TIER)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(tier).alias("tier"), F.max_by("o_orderstatus", F.struct(-tier, "o_orderkey")).alias("status"), F.max("o_orderdate").alias("last_seen"))


@query("""SELECT o_custkey, arg_min(o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS ended, arg_max(o_orderpriority, o_orderkey) AS notes FROM orders GROUP BY 1""")
def m8_relationship_fold(spark, d):
    """An end is set once; notes follow the last arrival."""
    o = table(spark, d, "orders").withColumn("ended", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    key = F.col("o_orderkey")
    return o.groupBy("o_custkey").agg(first_known("ended", key).alias("ended"), last_known("o_orderpriority", key).alias("notes"))


@query("""SELECT o_custkey, bool_or(o_orderstatus = 'P') AS is_primary, arg_max(o_orderpriority, o_orderkey) AS name, max(o_totalprice) AS confidence FROM orders GROUP BY 1""")
def m9_identifiers_fold(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "P").alias("is_primary"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("confidence"))
    return merged(o, ["o_custkey"], "o_orderkey", ever=["is_primary"], last=["name"], high=["confidence"])


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'imported' ELSE arg_max(o_orderstatus, o_orderkey) END AS status, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1""")
def m10_sticky_stage(spark, d):
    status = F.when(F.bool_or(F.col("o_orderstatus") == "F"), "imported").otherwise(F.max_by("o_orderstatus", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(status.alias("status"), F.max_by("o_totalprice", "o_orderkey").alias("price"))


@query("""SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey <= coalesce(decided, 9e18)) AS confidence, min(decided) IS NOT NULL AS decided FROM
(SELECT *, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS decided FROM orders) GROUP BY 1""")
def m11_proposed_only(spark, d):
    """Signals change only until a candidate is decided."""
    o = table(spark, d, "orders")
    end = F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).over(Window.partitionBy("o_custkey"))
    own = o.withColumn("decided", end).withColumn("open", F.col("decided").isNull() | (F.col("o_orderkey") <= F.col("decided")))
    return own.groupBy("o_custkey").agg(F.max_by("o_totalprice", F.when(F.col("open"), F.col("o_orderkey"))).alias("confidence"), F.first("decided").isNotNull().alias("decided"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1""")
def m12_last_evidence(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value"), F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(latest, c_mktsegment) AS segment, CASE latest WHEN '1-URGENT' THEN TRUE WHEN '5-LOW' THEN FALSE END AS urgent FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS latest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def m14_j17_filled_attributes(spark, d):
    """New values over old ones where there are any; a truth value of three states from text."""
    new = table(spark, d, "orders").filter("o_orderstatus != 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("latest"))
    own = table(spark, d, "customer").join(new, "c_custkey", "left")
    return own.select("c_custkey", F.coalesce("latest", "c_mktsegment").alias("segment"), F.when(F.col("latest") == "1-URGENT", True).when(F.col("latest") == "5-LOW", False).alias("urgent"))


@query("""SELECT l_orderkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, max(l_discount) AS confidence, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS flag FROM lineitem GROUP BY 1""")
def m15_provenance(spark, d):
    """The window widens, confidence rises, all else is as it came last."""
    last = F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.max("l_discount").alias("confidence"), last.alias("flag"))


@query(None)
def m16_folded_records(spark, d):
    """Records of an order's page that mean the same supplier: twice a fold in order; tests hold it against plain code."""
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_suppkey", "l_returnflag").alias("record"),
        F.concat_ws("-", "l_orderkey", "l_suppkey").alias("person"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("arrival"),
        F.col("l_discount").alias("confidence"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("p"), "l_partkey")).alias("phone"),
        F.array(F.concat(F.lit("a"), F.col("l_partkey") % 5)).alias("addresses"),
    )
    return folded_records(rows, "record", "person", "arrival", "confidence", ["phone"], ["addresses"]).select("person", "record", "confidence", "phone", "addresses")


@query("""SELECT p_brand AS code, arg_max(p_type, p_partkey) AS type, arg_max(p_size, p_partkey) AS size FROM part GROUP BY 1""")
def m17_reference_data(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("code"), "p_partkey", F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return merged(p, ["code"], "p_partkey", latest=["type", "size"])


@query("""SELECT user_id, event_type, arg_max(value, event_id) AS status, arg_min(props, event_id) AS token, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def m19_pages_of_a_run(spark, d):
    """Status follows the last arrival, what was there at first stays."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").alias("status"), F.col("props").alias("token"), F.col("ts").alias("last_ts"))
    return merged(e, ["user_id", "event_type"], "event_id", latest=["status"], frozen=["token"], high=["last_ts"])


# Runs.
@query("""SELECT user_id, event_id, CAST(sum(dry) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS pages FROM (SELECT *, sum(1 - dry) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT user_id, event_id, CASE WHEN min(event_id) OVER (PARTITION BY user_id, event_type) = event_id THEN 0 ELSE 1 END AS dry FROM events))""")
def w8_pages_without_new_records(spark, d):
    """How many pages in a row brought nothing new; a new record sets the count to 0."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    seen = F.min("event_id").over(Window.partitionBy("user_id", "event_type")) < F.col("event_id")
    own = e.withColumn("dry", seen)
    return consecutive(own, ["user_id"], ["event_id"], F.col("dry"), "pages").select("user_id", "event_id", F.col("pages").cast("long").alias("pages"))


@query("""SELECT event_id FROM (SELECT event_id, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 50000""")
def w9_cumulative_budget(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return within_spending(e, ["user_id"], ["event_id"], "cents", 50000).select("event_id")


@query("""SELECT user_id, min(event_id) AS event_id, 'link' AS reason FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1 AND event_id % 7 = 3 GROUP BY 1""")
def w2_e28_first_breaks(spark, d):
    """A chain of hashes by user, in which every row with event_id % 7 = 3 states a wrong hash before it."""
    e = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.concat_ws("|", "user_id", "event_id", "event_type"), 256).alias("hash"))
    right = F.lag("hash").over(Window.partitionBy("user_id").orderBy("event_id"))
    chained = e.withColumn("previous", F.when((F.col("event_id") % 7 == 3) & right.isNotNull(), F.lit("tampered")).otherwise(right))
    return first_breaks(chained, ["user_id"], "event_id", "hash", "previous")


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS sequence FROM events GROUP BY 1, 2""")
def w4_sequences(spark, d):
    own = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return own.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("at")).alias("sequence"))


@query("""SELECT o_custkey, o_orderkey, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AND NOT bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) OR o_orderstatus = 'P' AS is_primary FROM orders""")
def w6_first_is_primary(spark, d):
    """The first of a customer's identifiers is primary unless one already is."""
    o = table(spark, d, "orders")
    groups = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"), F.bool_or(F.col("o_orderstatus") == "P").alias("has"))
    at = groups.select("o_custkey", "has", F.posexplode("ids").alias("place", "o_orderkey"))
    return at.join(o.select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_custkey", "o_orderkey", (((F.col("place") == 0) & ~F.col("has")) | (F.col("o_orderstatus") == "P")).alias("is_primary"))
