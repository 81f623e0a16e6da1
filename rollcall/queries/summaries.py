"""Lateral, tiered and conflict joins; dashboards; filters, queues and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.latest import best_of
from ..operators.lookups import cascade, single_name, unique_keys, with_best
from .base import query, table

# Lateral joins.


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey""")
def j5_best_candidate(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").withColumn("c_custkey", F.col("o_custkey"))
    return with_best(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 2 END AS parent FROM supplier""")
def j6_direct_parent(spark, d):
    """One parent for each, the smallest id where there are several."""
    s = table(spark, d, "supplier").select("s_suppkey")
    edges = s.filter("s_suppkey > 0").select("s_suppkey", F.explode(F.array(F.floor((F.col("s_suppkey") - 1) / 2), F.col("s_suppkey") + 1)).alias("parent"))
    return with_best(s, edges, "s_suppkey", [F.col("parent")], ["parent"])


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def j7_newest_observation(spark, d):
    return best_of(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT c_custkey, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey IS NOT NULL)), '|'), '') AS priorities, count(o_orderkey) AS n, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS proposed
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j8_lateral_aggregate(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("proposed"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna("", ["priorities"]).fillna(0, ["n", "proposed"])


@query("""SELECT l_orderkey, l_suppkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A' DESC, l_shipdate, l_suppkey, l_linenumber) = 1""")
def j9_primary_location(spark, d):
    return best_of(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc(F.col("l_returnflag") == "A"), F.col("l_shipdate"), F.col("l_suppkey"), F.col("l_linenumber")]).select("l_orderkey", "l_suppkey", "l_shipdate")


# Joins on identifiers.


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_suppkey = c_custkey % 97 AND (CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END) IS NOT DISTINCT FROM (CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE c_nationkey END)""")
def j16_f6_exploded_identifiers(spark, d):
    """Identifiers in a JSON array, joined by system, state (nulls equal) and value."""
    s = table(spark, d, "supplier")
    mine = s.select("s_suppkey", F.lit("npi").alias("system"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("state"), F.col("s_suppkey").cast("string").alias("value"))
    v = F.col("c_custkey") % 97
    state = F.when(v % 3 != 0, F.col("c_nationkey"))
    made = F.to_json(F.array(F.struct(F.lit("npi").alias("system"), state.alias("state"), v.cast("string").alias("value")), F.struct(F.lit("tax").alias("system"), state.alias("state"), v.cast("string").alias("value"))))
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.from_json(made, "array<struct<system string, state int, value string>>")).alias("i")).select("c_custkey", "i.*").alias("c")
    m = mine.alias("m")
    same = (F.col("c.system") == F.col("m.system")) & F.col("c.state").eqNullSafe(F.col("m.state")) & (F.col("c.value") == F.col("m.value"))
    return c.join(m, same).select("c_custkey", "s_suppkey")


@query("""WITH pair AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS id FROM customer GROUP BY 1, 2 HAVING count(*) = 1), alias AS (SELECT c_nationkey, min(c_custkey) AS id FROM customer GROUP BY 1 HAVING count(*) = 1)
SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END, p.id, a.id) AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'claimed' WHEN p.id IS NOT NULL THEN 'pair' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'none' END AS tier
FROM supplier LEFT JOIN pair p ON p.c_nationkey = s_nationkey AND p.c_mktsegment = 'BUILDING' LEFT JOIN alias a ON a.c_nationkey = s_nationkey""")
def j18_j19_cascade(spark, d):
    """A claimed row, else the exact pair of keys if it is unique, else a unique alias."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.lit("BUILDING").alias("segment"))
    claimed = s.filter("s_suppkey % 4 = 0").select("s_suppkey", F.col("s_suppkey").alias("id"))
    tiers = [("claimed", claimed, ["s_suppkey"]), ("pair", unique_keys(c, ["nation", "segment"], "id"), ["nation", "segment"]), ("alias", unique_keys(c, ["nation"], "id"), ["nation"])]
    return cascade(s, tiers, "id").select("s_suppkey", "id", "tier")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'w' || s.s_suppkey END, 'w' || t.s_suppkey) AS website FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey % 13 LEFT JOIN supplier t ON t.s_suppkey = c_custkey % 7""")
def j20_first_matching_identifier(spark, d):
    """The website of the first of a record's identifiers that has one."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("i"), "s_suppkey").alias("identifier"), F.concat(F.lit("w"), "s_suppkey").alias("website"))
    k = F.col("c_custkey")
    ids = F.array(F.when(k % 5 != 0, F.concat(F.lit("i"), k % 13)), F.concat(F.lit("i"), k % 7))
    own = table(spark, d, "customer").select("c_custkey", F.posexplode(ids).alias("at", "identifier"))
    best = own.join(s, "identifier").groupBy("c_custkey").agg(F.min_by("website", "at").alias("website"))
    return table(spark, d, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query("""SELECT a.p_partkey AS part, b.owner AS other FROM part a JOIN (SELECT p_name, min(p_partkey) AS owner FROM part GROUP BY 1) b ON a.p_name = b.p_name AND a.p_partkey <> b.owner""")
def j21_identifier_conflicts(spark, d):
    """Rows whose identifier another row owns: its first."""
    p = table(spark, d, "part")
    owner = p.groupBy("p_name").agg(F.min("p_partkey").alias("other"))
    return p.join(owner, "p_name").filter("p_partkey != other").select(F.col("p_partkey").alias("part"), "other")


@query(r"""SELECT host, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS host FROM pages) GROUP BY 1 HAVING count(*) > 1""")
def j22_shared_hosts(spark, d):
    from ..functions.urls import host_of

    own = table(spark, d, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    return own.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).filter("pages > 1")


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS alone FROM supplier) SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS supplier FROM customer LEFT JOIN n a ON a.s_nationkey = c_nationkey AND a.alone = 1
LEFT JOIN n b ON b.s_nationkey = c_nationkey AND b.alone > 1 AND b.s_name = 'Supplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0')""")
def j24_resolved_context(spark, d):
    """The only organisation of a page, or the only one with the published name; else none."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 100).cast("string"), 9, "0")).alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("supplier"))
    return single_name(c, s, "nation", "name", "supplier").select("c_custkey", "supplier")


@query("""WITH e AS (SELECT c_nationkey AS k, max(c_custkey) AS id FROM customer WHERE c_acctbal > 9000 GROUP BY 1), i AS (SELECT c_mktsegment AS k, max(c_custkey) AS id FROM customer GROUP BY 1)
SELECT s_suppkey, coalesce(e.id, i.id) AS person, CASE WHEN e.id IS NOT NULL THEN 'published_email' WHEN i.id IS NOT NULL THEN 'identity_key' ELSE 'none' END AS strategy, CASE WHEN e.id IS NOT NULL THEN 0.98 WHEN i.id IS NOT NULL THEN CASE WHEN s_suppkey % 2 = 0 THEN 0.6 ELSE 0.85 END ELSE 0.0 END AS confidence
FROM supplier LEFT JOIN e ON e.k = s_nationkey LEFT JOIN i ON i.k = CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'NOBODY' END""")
def j25_person_resolution(spark, d):
    """A published address first, else the identity key, less surely where the name was a guess, else nobody."""
    c = table(spark, d, "customer")
    by_mail = c.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("mail")).agg(F.max("c_custkey").alias("person"))
    by_key = c.groupBy(F.col("c_mktsegment").alias("key")).agg(F.max("c_custkey").alias("person"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("mail"), F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise("NOBODY").alias("key"))
    out = cascade(s, [("published_email", by_mail, ["mail"]), ("identity_key", by_key, ["key"])], "person")
    sure = F.when(F.col("tier") == "published_email", 0.98).when(F.col("tier") == "identity_key", F.when(F.col("s_suppkey") % 2 == 0, 0.6).otherwise(0.85)).otherwise(0.0)
    return out.select("s_suppkey", "person", F.col("tier").alias("strategy"), sure.alias("confidence"))


# Aggregates.


@query("""SELECT * FROM (SELECT count(*) AS customers, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_mktsegment) AS segments, max(c_acctbal) AS best, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer),
(SELECT count(*) AS orders, count(DISTINCT o_custkey) AS buyers, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_orderdate) AS latest, min(o_orderdate) AS earliest FROM orders),
(SELECT count(*) AS lines, count(DISTINCT l_suppkey) AS sellers, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem), (SELECT count(*) AS suppliers FROM supplier), (SELECT count(*) AS parts, count(DISTINCT p_brand) AS brands FROM part),
(SELECT count(*) AS pages FROM pages), (SELECT count(*) AS events FROM events)""")
def a1_coverage_summary(spark, d):
    """Eighteen measures of seven tables, one row from each."""
    n = F.count("*")
    parts = [
        table(spark, d, "customer").agg(n.alias("customers"), F.count_distinct("c_nationkey").alias("nations"), F.count_distinct("c_mktsegment").alias("segments"), F.max("c_acctbal").alias("best"), F.count_if(F.col("c_acctbal") < 0).alias("negative")),
        table(spark, d, "orders").agg(n.alias("orders"), F.count_distinct("o_custkey").alias("buyers"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max("o_orderdate").alias("latest"), F.min("o_orderdate").alias("earliest")),
        table(spark, d, "lineitem").agg(n.alias("lines"), F.count_distinct("l_suppkey").alias("sellers"), F.count_if(F.col("l_returnflag") == "R").alias("returned")),
        table(spark, d, "supplier").agg(n.alias("suppliers")),
        table(spark, d, "part").agg(n.alias("parts"), F.count_distinct("p_brand").alias("brands")),
        table(spark, d, "pages").agg(n.alias("pages")),
        table(spark, d, "events").agg(n.alias("events")),
    ]
    return reduce(lambda a, b: a.join(b), parts)  # one row each


@query("""SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_status FROM orders GROUP BY 1""")
def a2_count_and_latest(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest_status"))


@query("""SELECT c_custkey, count(o_orderkey) AS jobs, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS finished, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def a5_batch_counts(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0)


@query("""SELECT event_type, min(ts) AS since, min(user_id) AS least_user, min(value) AS least_value, min(event_id) AS first_event, count(*) AS held FROM events WHERE value > 50 GROUP BY 1""")
def a6_hold_summary(spark, d):
    held = table(spark, d, "events").filter("value > 50")
    return held.groupBy("event_type").agg(F.min("ts").alias("since"), F.min("user_id").alias("least_user"), F.min("value").alias("least_value"), F.min("event_id").alias("first_event"), F.count("*").alias("held"))


@query("""SELECT n_nationkey, coalesce(c.people, 0) AS people, coalesce(c.negative, 0) AS negative, coalesce(c.segments, 0) AS segments, coalesce(o.orders, 0) AS orders, coalesce(o.done, 0) AS done, coalesce(o.open, 0) AS open, coalesce(o.held, 0) AS held, coalesce(o.urgent, 0) AS urgent,
coalesce(o.cents, 0) AS cents, coalesce(s.suppliers, 0) AS suppliers, coalesce(s.indebted, 0) AS indebted, o.latest FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS people, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS held, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_orderdate) AS latest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) o ON o.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers, count(*) FILTER (WHERE s_acctbal < 0) AS indebted FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def a7_project_summary(spark, d):
    """Twelve measures of three facts, each aggregated before it is joined."""
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    by = lambda df, key: df.groupBy(F.col(key).alias("n_nationkey"))
    people = by(c, "c_nationkey").agg(F.count("*").alias("people"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_distinct("c_mktsegment").alias("segments"))
    status = F.col("o_orderstatus")
    mine = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    orders = by(mine, "c_nationkey").agg(
        F.count("*").alias("orders"), F.count_if(status == "F").alias("done"), F.count_if(status == "O").alias("open"), F.count_if(status == "P").alias("held"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderdate").alias("latest"))
    sellers = by(s, "s_nationkey").agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") < 0).alias("indebted"))
    out = table(spark, d, "nation").select("n_nationkey")
    for part in (people, orders, sellers):
        out = out.join(part, "n_nationkey", "left")
    return out.fillna(0)


@query("""SELECT o_custkey, '[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1""")
def a8_nested_rows(spark, d):
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(rows).alias("orders"))


@query("""SELECT o_custkey, o_orderdate, min(o_orderstatus) AS status FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = 1""")
def a9_only_value(spark, d):
    return unique_keys(table(spark, d, "orders"), ["o_custkey", "o_orderdate"], "o_orderstatus").withColumnRenamed("o_orderstatus", "status")


@query("""SELECT source, count(*) AS rows, count(DISTINCT text) AS texts, count(DISTINCT text) = count(*) AS complete FROM documents GROUP BY 1""")
def a13_completeness(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts")).withColumn("complete", F.col("rows") == F.col("texts"))


@query("""SELECT reason, dataset, count(*) AS n FROM (SELECT o_orderpriority AS dataset, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'too_dear' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_custkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS reason FROM orders) GROUP BY 1, 2 ORDER BY n DESC, dataset, reason LIMIT 25""")
def a15_bundle_summary(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") > 300000, "too_dear"), F.when(F.col("o_orderstatus") == "P", "open"), F.when(F.col("o_custkey") % 2 == 0, "even")))
    own = table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.explode(reasons).alias("reason"))
    return own.groupBy("reason", "dataset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dataset", "reason").limit(25)


@query("""SELECT source, lang, count(*) FILTER (WHERE text <> '') AS present, count(*) FILTER (WHERE coalesce(text, '') = '') AS missing FROM documents GROUP BY 1, 2""")
def a16_source_counters(spark, d):
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count_if(~empty).alias("present"), F.count_if(empty).alias("missing"))


@query("""SELECT user_id, count(*) AS pages, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS seconds FROM events GROUP BY 1""")
def a19_run_stats(spark, d):
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("pages"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("bytes"), span.alias("seconds"))


@query("""SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 ORDER BY 1""")
def a20_uncovered_areas(spark, d):
    n = table(spark, d, "nation")
    covered = n.join(table(spark, d, "supplier").filter("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return n.select("n_name").subtract(covered).orderBy("n_name")


# Filters.


@query("""SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'a') AND c_custkey > 20 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def f1_f3_exportable_rows(spark, d):
    """A conjunction of the filters that are given; an empty list is none."""
    from ..operators.filters import chosen, within

    c = table(spark, d, "customer")
    regions = table(spark, d, "nation").filter("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("c_nationkey"))
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    own = chosen(c, search=("A", ["c_name", "c_mktsegment"]), after=("c_custkey", 20), among={"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": []})
    return within(within(own, regions, "c_nationkey"), done, "c_custkey").select("c_custkey")


@query("""SELECT p_partkey, p_name ILIKE '%r_d%' AS liked, CASE WHEN p_size % 2 = 0 THEN 'published' ELSE 'missing' END AS state FROM part WHERE p_name ILIKE '%r_d%' OR p_size < 20""")
def f4_f5_wildcards_and_availability(spark, d):
    from ..operators.filters import available

    p = table(spark, d, "part").filter(F.col("p_name").ilike("%r_d%") | (F.col("p_size") < 20))
    p = p.withColumn("website", F.when(F.col("p_size") % 2 == 0, F.lit("w")))
    both = [available(p, "website", s).withColumn("state", F.lit(s)) for s in ("published", "missing")]
    return both[0].union(both[1]).select("p_partkey", F.col("p_name").ilike("%r_d%").alias("liked"), "state")


@query("""SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3, 5, 8)""")
def f7_json_path(spark, d):
    own = F.from_json("props", "k bigint")
    return table(spark, d, "events").filter(own["k"].isin(1, 2, 3, 5, 8)).select("event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate <= DATE '1997-06-30' AND (CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END IS NULL OR o_orderdate + INTERVAL 30 DAY >= DATE '1997-06-30')""")
def f8_effective_dates(spark, d):
    """Both ends included, an open end without one."""
    from ..operators.graph import effective

    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("effective_from"), F.when(F.col("o_orderstatus") != "O", F.date_add("o_orderdate", 30)).alias("effective_to"))
    return effective(o, "1997-06-30").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def f10_source_evidence(spark, d):
    from ..operators.filters import within

    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    return within(within(c, o.filter("o_orderstatus = 'F'"), "c_custkey"), o.filter("o_orderpriority = '1-URGENT'"), "c_custkey")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderkey) = 1""")
def f11_case_ranked(spark, d):
    from ..operators.filters import ranked

    return best_of(table(spark, d, "orders"), ["o_custkey"], [ranked("o_orderstatus", ["P", "F"]), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# Sorts, queues and pages.


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS last_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS first_name FROM customer ORDER BY last_name NULLS LAST, first_name NULLS LAST, c_custkey LIMIT 100""")
def l1_people_order(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("last_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("first_name"))
    return c.orderBy(F.asc_nulls_last("last_name"), F.asc_nulls_last("first_name"), "c_custkey").limit(100)


@query("""SELECT chunk, count(*) AS rows, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 200 AS chunk FROM customer WHERE c_acctbal >= 0 AND c_nationkey <> 7) GROUP BY 1""")
def l3_export_chunks(spark, d):
    """Chunks of 200 rows in order of a dense key, numbered without one task that holds all rows."""
    from ..operators.filters import numbered

    c = table(spark, d, "customer").filter("c_acctbal >= 0 and c_nationkey != 7").select("c_custkey")
    own = numbered(c, "c_custkey", "place").withColumn("chunk", F.floor(F.col("place") / 200))
    return own.groupBy("chunk").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query("""(SELECT 'identity' AS queue, c_custkey AS id FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 20) UNION ALL (SELECT 'quality', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20) UNION ALL (SELECT 'recent', event_id FROM events ORDER BY ts DESC, event_id LIMIT 20)""")
def l5_review_queues(spark, d):
    top = lambda df, name, id_, *order: df.orderBy(*order).limit(20).select(F.lit(name).alias("queue"), F.col(id_).alias("id"))
    a = top(table(spark, d, "customer").filter("c_acctbal < 0"), "identity", "c_custkey", "c_acctbal", "c_custkey")
    b = top(table(spark, d, "orders"), "quality", "o_orderkey", "o_totalprice", "o_orderkey")
    return a.union(b).union(top(table(spark, d, "events"), "recent", "event_id", F.desc("ts"), "event_id"))


@query(r"""SELECT href, max(score) AS score, arg_max(page_id, (score, -page_id)) AS page_id FROM (SELECT page_id, page_id % 10 / 10.0 AS score, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def l6_best_links(spark, d):
    own = table(spark, d, "pages").select("page_id", (F.col("page_id") % 10 / 10.0).alias("score"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return own.groupBy("href").agg(F.max("score").alias("score"), F.max_by("page_id", F.struct("score", -F.col("page_id"))).alias("page_id"))


@query(r"""SELECT page_id, coalesce(min_by(adapter, (-score, ord)), 'none') AS adapter FROM (SELECT page_id, unnest([{'adapter': 'table', 'ord': 0, 'need': 0.5, 'score': length(html) % 10 / 10.0}, {'adapter': 'list', 'ord': 1, 'need': 0.6, 'score': length(html) % 7 / 7.0}, {'adapter': 'any', 'ord': 2, 'need': 0.5, 'score': length(html) % 10 / 10.0}], recursive := true) FROM pages)
WHERE score >= need GROUP BY 1 UNION ALL SELECT page_id, 'none' FROM pages WHERE length(html) % 10 < 5 AND length(html) % 7 / 7.0 < 0.6""")
def l7_adapter_choice(spark, d):
    """The adapter with the highest score that reaches its own threshold, the first registered on ties; else none."""
    from ..operators.filters import best_registered

    n = F.length("html")
    own = [("table", 0.5, n % 10 / 10.0), ("list", 0.6, n % 7 / 7.0), ("any", 0.5, n % 10 / 10.0)]
    return table(spark, d, "pages").select("page_id", best_registered(own).alias("adapter"))


@query("""SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS busy FROM orders WHERE o_orderdate >= DATE '1996-01-01') WHERE n = 1 AND busy = 0""")
def l8_next_jobs(spark, d):
    """For each domain without an active job the next by priority and age, of those not expired."""
    live = table(spark, d, "orders").filter("o_orderdate >= date'1996-01-01'")
    busy = live.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    return best_of(live.join(busy, "o_custkey", "left_anti"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey")


@query(r"""SELECT page_id, CASE WHEN host = 'tiontion.example.com' THEN 'p3' WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'p2' ELSE 'p1' END AS policy, CASE WHEN regexp_matches(path, '^/en/') AND NOT regexp_matches(path, '^/en/[0-4]') THEN FALSE ELSE TRUE END AS allowed
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(www|blog|m)\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def l9_l10_policies_and_robots(spark, d):
    """The most specific policy of a page (exact host 3, domain 2, all 1); the longest robots rule, allow wins ties."""
    from ..functions.urls import AUTHORITY, domain_suffixes, full_host
    from ..operators.filters import robots_allow

    policies = spark.createDataFrame([("p3", "tiontion.example.com", 3), ("p2", "example.org", 2), ("p1", "*", 1), ("p0", "*", 1)], "policy string, domain string, score int")
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(full_host(F.col("url")), r"^(?:www|blog|m)\.", "").alias("host"), F.regexp_extract("url", AUTHORITY, 4).alias("path"))
    named = p.select("page_id", "host", F.explode(F.concat(domain_suffixes(F.col("host")), F.array(F.lit("*")))).alias("domain")).join(F.broadcast(policies), "domain")
    named = named.filter((F.col("score") < 3) | (F.col("domain") == F.col("host")))
    best = named.groupBy("page_id").agg(F.max_by("policy", F.struct("score", "policy")).alias("policy"))
    rules = [("disallow", "/en/"), ("allow", "/en/0"), ("allow", "/en/1"), ("allow", "/en/2"), ("allow", "/en/3"), ("allow", "/en/4"), ("allow", "/fr/"), ("disallow", "/fr/")]
    return p.select("page_id", robots_allow(F.col("path"), rules).alias("allowed")).join(best, "page_id")


@query("""SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem""")
def u4_distinct_targets(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("""SELECT s_suppkey, 'a|b|' || CASE WHEN s_suppkey % 2 = 0 THEN 'c' ELSE 'd' END || CASE WHEN s_suppkey % 3 = 0 THEN '|e' ELSE '' END AS words, CASE WHEN s_suppkey % 2 = 0 THEN 0.9 ELSE 0.5 END AS weight FROM supplier""")
def u5_merged_vocabularies(spark, d):
    """Lists united in order, each word once; of hints with one pattern the greatest weight."""
    k = F.col("s_suppkey")
    own = F.array(F.when(k % 2 == 0, "c").otherwise("d"), F.lit("a"))
    more = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("e"))).otherwise(F.array(F.lit("b")))
    words = F.array_join(F.array_union(F.array_union(F.array(F.lit("a"), F.lit("b")), own), more), "|")
    hints = F.array(F.struct(F.lit("/x").alias("p"), F.lit(0.5).alias("w")), F.struct(F.lit("/x").alias("p"), F.when(k % 2 == 0, 0.9).otherwise(0.1).alias("w")))
    each = table(spark, d, "supplier").select("s_suppkey", words.alias("words"), F.explode(hints).alias("h"))
    return each.groupBy("s_suppkey", "words", "h.p").agg(F.max("h.w").alias("weight")).select("s_suppkey", "words", "weight")
