"""Joins, aggregates, windows, sorts, sets and folds over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators.graph import ancestry, subtree
from ..operators.latest import best_of, merged
from ..operators.percentiles import nearest_rank
from ..operators.runs import chain_breaks, consecutive, within_budget
from ..operators.suppression import withheld
from ..sinks import csv_line
from .base import query, table

TREE = "SELECT c_custkey AS child, (c_custkey - 2) // 4 + 1 AS parent FROM customer WHERE c_custkey > 1"


def _tree(customers: DataFrame) -> DataFrame:
    """Customers as a balanced four-child tree by key."""
    return customers.filter("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.expr("cast(floor((c_custkey - 2) / 4) as bigint) + 1").alias("parent"))


@query(f"""WITH RECURSIVE e AS ({TREE}), a AS (SELECT c_custkey AS node, c_custkey AS ancestor, 0 AS depth FROM customer
UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON e.child = a.ancestor WHERE a.depth < 12) SELECT node, ancestor, depth FROM a""")
def g1_ancestry(spark, d):
    c = table(spark, d, "customer")
    return ancestry(c.select(F.col("c_custkey").alias("node")), _tree(c))


@query(f"""WITH RECURSIVE e AS ({TREE}), s AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < -950
UNION SELECT e.child FROM s JOIN e ON e.parent = s.node) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT node FROM s)""")
def g5_subtree_suppression(spark, d):
    c = table(spark, d, "customer")
    roots = c.filter("c_acctbal < -950").select(F.col("c_custkey").alias("node"))
    gone = subtree(roots, _tree(c))
    return c.join(gone.withColumnRenamed("node", "c_custkey"), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1""")
def j4_best_order(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = best_of(table(spark, d, "orders"), ["o_custkey"], [rank, F.desc("o_orderdate"), F.col("o_orderkey")])
    return table(spark, d, "customer").join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def j1_j3_joins(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, (n.n_regionkey == r.r_regionkey) & (r.r_name != "ASIA"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)
AND c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def j10_scoped_suppression(spark, d):
    n, o = table(spark, d, "nation"), table(spark, d, "orders")
    entries = n.filter("n_regionkey = 0").select(F.lit("nation").alias("scope"), F.col("n_nationkey").cast("string").alias("value"))
    entries = entries.union(o.filter("o_orderstatus = 'P'").select(F.lit("customer"), F.col("o_custkey").cast("string")).distinct())
    entries = entries.union(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.lit("segment"), F.col("c_mktsegment")).distinct())
    out = withheld(table(spark, d, "customer"), entries, {"nation": "c_nationkey", "customer": "c_custkey", "segment": "c_mktsegment"})
    return out.select("c_custkey", "c_mktsegment")


@query("""SELECT page_id FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]*)', 1)), '^www\\.|\\.+$', '', 'g') AS host FROM pages)
WHERE NOT (host = 'example.org' OR host LIKE '%.example.org')""")
def j12_domain_suppression(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(U.domain_suffixes(U.host_of(F.col("url")))).alias("domain"))
    hit = p.join(F.broadcast(spark.createDataFrame([("example.org",)], "domain string")), "domain", "left_semi").select("page_id").distinct()
    return table(spark, d, "pages").select("page_id").join(hit, "page_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j13_semi(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000)")
def j14_anti(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal > 0) AS nations,
max(c_acctbal) AS most FROM customer GROUP BY c_mktsegment""")
def a4_filtered_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))).alias("nations"), F.max("c_acctbal").alias("most")
    )


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations, (SELECT count(*) FROM orders) AS orders,
(SELECT max(o_orderdate) FROM orders) AS latest, (SELECT count(*) FROM supplier) AS suppliers""")
def a1_coverage(spark, d):
    c = table(spark, d, "customer").agg(F.count("*").alias("customers"), F.count_distinct("c_nationkey").alias("nations"))
    o = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"))
    return c.join(o).join(table(spark, d, "supplier").agg(F.count("*").alias("suppliers")))  # one row each


@query("""SELECT c_custkey, count(o_orderkey) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def a7_order_summary(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).cast("double").alias("total"), "latest")


@query("""SELECT p_brand, count(DISTINCT p_type) AS types, min(p_type) AS any_type FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def a10_conflicts(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.min("p_type").alias("any_type")).filter("types > 1")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean,
list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INTEGER)] AS p95, max(value) AS most FROM events GROUP BY event_type""")
def a18_durations(spark, d):
    """Count, total, mean, nearest-rank 95th percentile, greatest."""
    return nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@query("""SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3""")
def a11_histogram_top(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(3)


@query("""SELECT user_id, event_id, CAST(sum(bad) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS streak FROM (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, event_id, ts, CASE WHEN value < 50 THEN 1 ELSE 0 END AS bad FROM events))""")
def w7_consecutive(spark, d):
    return consecutive(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 50).select("user_id", "event_id", F.col("streak").cast("long").alias("streak"))


@query("""SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5""")
def w9_budget(spark, d):
    return within_budget(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id")


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type""")
def w2_chain_breaks(spark, d):
    return chain_breaks(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "event_type").select("event_id", "user_id")


@query("""SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(props, event_id) AS props, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id""")
def m1_merge_fold(spark, d):
    return merged(table(spark, d, "events"), ["user_id"], "event_id", first=["event_type"], last=["props"], low=["ts"], high=["ts"])


@query("""SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS p_name FROM part GROUP BY p_brand""")
def m1_longest_name(spark, d):
    return merged(table(spark, d, "part"), ["p_brand"], "p_partkey", longest=["p_name"])


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def m6_insert_once(spark, d):
    return best_of(table(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build')""")
def f2_search(spark, d):
    return table(spark, d, "customer").filter(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build"))).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 200 ORDER BY c_custkey LIMIT 50")
def l2_keyset_page(spark, d):
    return table(spark, d, "customer").filter("c_custkey > 200").orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("SELECT c_custkey, count(*) OVER () AS total FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def w1_l4_page_with_total(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    total = c.agg(F.count("*").alias("total"))
    return c.orderBy("c_custkey").offset(50).limit(25).join(F.broadcast(total))  # one row


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01' AND l_returnflag IN ('A', 'R')")
def f8_effective_range(spark, d):
    return table(spark, d, "lineitem").filter("l_shipdate >= timestamp'1995-01-01' and l_shipdate < timestamp'1995-02-01' and l_returnflag in ('A', 'R')").select("l_orderkey", "l_linenumber")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a3_two_key_groups(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u1_union_all(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name"))


@query("(SELECT c_nationkey + 100 * (c_custkey % 2) AS k, 'only' AS side FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey < 5 EXCEPT SELECT c_nationkey, 'only' FROM customer WHERE c_nationkey > 9) UNION ALL (SELECT n_nationkey, 'both' FROM nation INTERSECT SELECT c_nationkey, 'both' FROM customer WHERE c_nationkey > 9)")
def u6_set_difference(spark, d):
    """EXCEPT and INTERSECT: each row once, however often it is there."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    high = c.filter("c_nationkey > 9")
    left = c.filter("c_custkey % 2 = 0 or c_nationkey < 5").select((F.col("c_nationkey") + 100 * (F.col("c_custkey") % 2)).alias("k"), F.lit("only").alias("side"))
    both = n.select(F.col("n_nationkey").cast("long").alias("k"), F.lit("both").alias("side")).intersect(high.select(F.col("c_nationkey").cast("long"), F.lit("both")))
    return left.subtract(high.select(F.col("c_nationkey").cast("long"), F.lit("only"))).union(both)


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS key, substr(sha256(p_name), 1, 24) AS record_key FROM part""")
def x2_x59_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.key_of(F.col("p_name")).alias("key"), T.short_hash(F.col("p_name"), 24).alias("record_key"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"')) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def h14_link_harvest(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def x65_json_access(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT s_suppkey, field, raw FROM (SELECT s_suppkey, 'name' AS field, s_name AS raw FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier) WHERE raw IS NOT NULL""")
def e8_unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return s.unpivot("s_suppkey", ["name", "nation"], "field", "raw").filter("raw is not null")


#: Values that meet at once, a multiple of 8 since Parquet packs by 8; and keys of a file, more of which would not fit the table that numbers them.
RUN, KEYS_A_FILE = 256, 100_000


def _runs(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(k, list, value): n rows' values of each k, null ones too, as arrays of RUN: lists are dealt by a hash and cut, so that
    few arrays are shorter."""
    lists = F.lit(max(1, n // (25 * 16 * RUN)))
    rows = rows.filter("k is not null").withColumn("list", F.pmod(F.xxhash64(F.lit("list"), value), lists))
    own = F.concat(F.collect_list(value), F.array_repeat(F.lit(None).cast("long"), F.count_if(F.col(value).isNull()).cast("int")))
    cut = F.transform(F.sequence(F.lit(1), F.size("own"), F.lit(RUN)), lambda i: F.slice("own", i, RUN))
    return rows.groupBy("k", "list").agg(own.alias("own")).select("k", "list", F.explode(cut).alias(value))


@query("""SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON s_nationkey = o_orderkey % 25 OR s_nationkey = (o_orderkey + 7) % 25""")
def j15_array_containment(spark, d):
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    keys = F.array_distinct(F.array(F.col("o_orderkey") % 25, (F.col("o_orderkey") + 7) % 25))
    # Each order meets all suppliers of its nations. Runs of orders meet runs of suppliers, a nation's together, so that files hold
    # the same short run of suppliers again and again, which packs to little.
    orders, suppliers = 2 * o.count(), s.count()
    o = _runs(o.select("o_orderkey", F.explode(keys).alias("k")), "o_orderkey", orders)
    s = _runs(s.select("s_suppkey", F.col("s_nationkey").cast("long").alias("k")), "s_suppkey", suppliers)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders // KEYS_A_FILE))
    met = o.repartitionByRange(n, "k", "list").join(F.broadcast(s.select("k", "s_suppkey")), "k")
    # All that a row becomes is held until it is read, unless a step between ends the compiled code: coalesce, which merges nothing here.
    met = met.coalesce(n).select(F.explode("o_orderkey").alias("o_orderkey"), "s_suppkey").coalesce(n)
    return met.select("o_orderkey", F.explode("s_suppkey").alias("s_suppkey"))


@query("""SELECT c_custkey, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer""")
def j23_latest_by_key(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest")


@query("""SELECT o_custkey, o_orderpriority, dense_rank() OVER (PARTITION BY o_custkey ORDER BY f, o_orderpriority) AS version FROM
(SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)""")
def w3_version_ordinals(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("f"))
    order = Window.partitionBy("o_custkey").orderBy("f", "o_orderpriority")
    return first.select("o_custkey", "o_orderpriority", F.dense_rank().over(order).alias("version"))


@query("""SELECT p_brand, min(p_partkey) AS p_partkey, count(*) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def a9_a10_keepers(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n"), F.count_distinct("p_type").alias("k")).filter("k > 1").drop("k")


@query(f"""WITH RECURSIVE e AS ({TREE}), a AS (SELECT c_custkey AS node, c_custkey AS ancestor, 0 AS depth FROM customer
UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON e.child = a.ancestor WHERE a.depth < 12)
SELECT node, ancestor, min(depth) AS depth FROM a WHERE depth > 0 GROUP BY 1, 2""")
def g2_nearest_ancestors(spark, d):
    c = table(spark, d, "customer")
    return ancestry(c.select(F.col("c_custkey").alias("node")), _tree(c)).filter("depth > 0").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


@query("""SELECT l_orderkey, max(l_discount) AS confidence, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
arg_max(l_linestatus, (l_linenumber, l_linestatus)) AS mode, bool_or(l_returnflag = 'R') AS sticky FROM lineitem GROUP BY l_orderkey""")
def m10_m15_window_fold(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_discount").alias("confidence"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"),
        F.max_by("l_linestatus", F.struct("l_linenumber", "l_linestatus")).alias("mode"), F.bool_or(F.col("l_returnflag") == "R").alias("sticky"))


@query("""SELECT c_custkey, concat_ws(',', c_custkey::VARCHAR, CASE WHEN regexp_matches(c_name, '[",\\r\\n]|^ | $') THEN '"' || replace(c_name, '"', '""') || '"'
ELSE coalesce(c_name, '') END, CASE WHEN regexp_matches(c_mktsegment, '[",\\r\\n]|^ | $') THEN '"' || replace(c_mktsegment, '"', '""') || '"'
ELSE coalesce(c_mktsegment, '') END) AS line FROM customer""")
def k1_csv_lines(spark, d):
    return table(spark, d, "customer").select("c_custkey", csv_line("c_custkey", "c_name", "c_mktsegment").alias("line"))


@query("""SELECT s_suppkey, n_name FROM supplier JOIN (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey
ORDER BY length(n_name) DESC, n_nationkey) AS n FROM nation) ON n_regionkey = s_suppkey % 5 AND n = 1""")
def l9_l10_most_specific(spark, d):
    order = F.struct(F.length("n_name"), -F.col("n_nationkey"))
    best = table(spark, d, "nation").groupBy("n_regionkey").agg(F.max_by("n_name", order).alias("n_name"))
    return table(spark, d, "supplier").join(best, F.col("s_suppkey") % 5 == F.col("n_regionkey")).select("s_suppkey", "n_name")


@query("""SELECT CASE WHEN o_totalprice < 0 THEN 'invalid' WHEN o_orderstatus = 'F' THEN 'covered' WHEN o_orderdate < DATE '1995-01-01' THEN 'outside'
ELSE 'eligible' END AS outcome, count(*) AS n FROM orders GROUP BY 1""")
def a14_first_match_counts(spark, d):
    outcome = F.when(F.col("o_totalprice") < 0, "invalid").when(F.col("o_orderstatus") == "F", "covered").when(F.col("o_orderdate") < F.lit("1995-01-01").cast("date"), "outside")
    return table(spark, d, "orders").groupBy(outcome.otherwise("eligible").alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey NULLS LAST, c_acctbal DESC, c_custkey LIMIT 50""")
def l1_l5_top_queue(spark, d):
    return table(spark, d, "customer").orderBy(F.asc_nulls_last("c_nationkey"), F.desc("c_acctbal"), "c_custkey").limit(50).select("c_nationkey", "c_custkey")
