"""Keyed stream state over the given events, in several triggers with restarts, against SQL that goes row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import folder
from ..shipping import ship
from .base import query, table

#: The events as pages of a run for each user.
PAGES = """SELECT user_id AS run, event_id AS ord, ts AS seen, props AS url, concat('d', CAST(event_id % 3 AS STRING)) AS domain, CAST(floor(value) AS INT) % 7 AS depth, event_id % 31 = 0 AS excluded,
CASE WHEN event_id % 5 = 0 THEN concat('t', CAST(event_id % 50 AS STRING)) END AS token, event_type <> 'error' AS ok, concat(event_type, CAST(floor(value) AS INT) % 40) AS content, event_id % 100 AS record FROM {events}"""

_SQL = f"""WITH RECURSIVE e AS (SELECT *, CASE WHEN record % 9 = 0 THEN [] ELSE ['r' || record, 'r' || (record % 10)] END AS records, row_number() OVER (PARTITION BY run ORDER BY ord) AS n FROM ({PAGES.format(events="events")})),
s AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS verdict, 0 AS pages, 0 AS dry, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS doms, CAST([] AS VARCHAR[]) AS fails, CAST([] AS VARCHAR[]) AS tokens,
CAST([] AS VARCHAR[]) AS contents, CAST([] AS VARCHAR[]) AS recs FROM e
UNION ALL SELECT run, n, ord, verdict, CASE WHEN fetched THEN pages + 1 ELSE pages END, CASE WHEN NOT fetched OR verdict IN ('duplicate_content', 'empty_success') THEN dry WHEN fresh THEN 0 ELSE dry + 1 END, CASE WHEN fetched THEN list_append(urls, url) ELSE urls END,
CASE WHEN fetched THEN list_append(doms, domain) ELSE doms END, CASE WHEN fetched THEN list_filter(fails, lambda x: x <> domain) WHEN verdict = 'failed' THEN list_append(fails, domain) ELSE fails END,
CASE WHEN gate IS NULL AND token IS NOT NULL THEN list_append(tokens, token) ELSE tokens END, CASE WHEN fetched THEN list_append(contents, content) ELSE contents END,
CASE WHEN fetched AND verdict <> 'duplicate_content' THEN list_concat(recs, records) ELSE recs END
FROM (SELECT *, verdict NOT IN ('pagination_loop', 'failed') AND gate IS NULL AS fetched FROM (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN token IS NOT NULL AND list_contains(tokens, token) THEN 'pagination_loop' WHEN NOT ok THEN 'failed'
WHEN list_contains(contents, content) THEN 'duplicate_content' WHEN len(records) = 0 AND depth = 0 THEN 'empty_success' WHEN NOT fresh AND dry + 1 >= 3 THEN 'no_progress' ELSE 'continue' END AS verdict
FROM (SELECT s.* EXCLUDE (n, ord, verdict), e.* EXCLUDE (run), len(list_filter(e.records, lambda x: NOT list_contains(s.recs, x))) > 0 AS fresh, CASE WHEN s.pages >= 40 THEN 'page_budget_exhausted' WHEN e.depth > 5 THEN 'too_deep' WHEN list_contains(s.urls, e.url) THEN 'visited'
WHEN len(list_filter(s.doms, lambda x: x = e.domain)) >= 9 THEN 'domain_budget_exhausted' WHEN len(list_filter(s.fails, lambda x: x = e.domain)) >= 3 THEN 'repeated_failures' WHEN e.excluded THEN 'excluded' END AS gate
FROM s JOIN e ON e.run = s.run AND e.n = s.n + 1))))
SELECT run, ord, verdict FROM s WHERE n > 0"""


@query(_SQL)
def t1_guard_state(spark, d):
    """What stops each page of a run, from state that a stream keeps over three arrivals and a restart after each."""
    from ..streaming import guards

    ship(spark)
    source, target, state = (folder(spark, x) for x in ("pages", "verdicts", "state"))
    records = F.when(F.col("record") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), F.col("record")), F.concat(F.lit("r"), F.col("record") % 10)))
    pages = spark.sql(PAGES.format(events="{events}"), events=table(spark, d, "events")).withColumn("records", records).drop("record")
    last = pages.agg(F.max("ord")).first()[0] or 0
    policy = guards.Policy(pages_per_run=40, pages_per_domain=9, deepest=5, failures_per_domain=3, pages_without_new=3)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            part = F.greatest(F.lit(0), F.least(F.lit(2), F.floor(F.col("ord") * 3 / (last + 1))))
            pages.filter(part == k).write.mode("append").parquet(source)
            guards.guarded(spark.readStream.schema(guards.PAGES).parquet(source), policy, target, state).awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(guards.VERDICTS).parquet(target)
