"""Audit events of each user as chains of hashes, over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.audit import chained, verified
from ..shared import folder, written
from .base import query, table

_K = "CAST(event_id % 90 AS STRING)"
#: Metadata with keys in another order, an exponent, escapes and spaces; and their canonical text.
RAW = f"""concat('{{"zz" :', {_K}, ', "value": {{"b": 1.50, "aa": [1e2 , "ab/"]}}, "k":', {_K}, ', "zz": null}}')"""
PLAIN = """'{"k": ' || CAST(e.sequence % 90 AS VARCHAR) || ', "zz": null, "value": {"b": 1.50, "aa": [100, "ab/"]}}'"""
EVENTS = {
    "chain": "user_id",
    "sequence": "event_id",
    "occurred": "ts",
    "actor_type": "'user'",
    "actor": "concat('u', CAST(user_id AS STRING))",
    "action": "event_type",
    "subject_type": "CASE WHEN event_id % 4 > 0 THEN 'page \"x\"' END",
    "subject": "CASE WHEN event_id % 3 > 0 THEN concat('s', CAST(event_id AS STRING)) END",
    "metadata": f"CASE WHEN event_id % 5 > 0 THEN {RAW} END",
}
_JSON = lambda c: f"""coalesce('"' || replace({c}, '"', '\\"') || '"', 'null')"""
_TEXT = f"""'{{"action": ' || {_JSON("e.action")} || ', "version": 1, "metadata": ' || CASE WHEN e.sequence % 5 > 0 THEN {PLAIN} ELSE '{{}}' END || ', "actorType": "user", "occurredAt": "' || strftime(e.occurred, '%Y-%m-%dT%H:%M:%S.%fZ')
|| '", "subjectType": ' || {_JSON("e.subject_type")} || ', "previousHash": ' || coalesce('"' || c.hash || '"', 'null') || ', "sequenceNumber": ' || e.sequence || ', "actorIdentifier": ' || {_JSON("e.actor")} || ', "subjectIdentifier": ' || {_JSON("e.subject")} || '}}'"""
_CHAIN = f"""WITH RECURSIVE e AS (SELECT chain, sequence, occurred, actor, action, subject_type, subject, row_number() OVER (PARTITION BY chain ORDER BY sequence) AS n FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in EVENTS.items())} FROM events)),
c AS (SELECT DISTINCT chain, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS previous_hash, CAST(NULL AS VARCHAR) AS hash FROM e
UNION ALL SELECT e.chain, e.n, e.sequence, c.hash, sha256({_TEXT}) FROM c JOIN e ON e.chain = c.chain AND e.n = c.n + 1)"""


def _events(spark, d):
    return table(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in EVENTS.items()])


@query(f"{_CHAIN} SELECT chain, sequence, previous_hash, hash FROM c WHERE n > 0")
def x63_e28_audit_chains(spark, d):
    """Events appended in two parts, the second behind the last hashes of the first."""
    e = _events(spark, d)
    first = chained(e.filter("sequence % 1000 < 500 and sequence < 500"))
    last = first.groupBy("chain").agg(F.max_by("hash", "sequence").alias("hash"))
    return first.union(chained(e.filter("not (sequence % 1000 < 500 and sequence < 500)"), last=last)).select("chain", "sequence", "previous_hash", "hash")


@query("""SELECT chain, sequence, CASE WHEN n = 5 THEN 'link' ELSE 'content' END AS reason FROM (SELECT user_id AS chain, event_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
WHERE sequence % 7 = 3 OR n = 5 QUALIFY row_number() OVER (PARTITION BY chain ORDER BY sequence) = 1""")
def e28_verified_chains(spark, d):
    """Chains in which every event with sequence % 7 = 3 was changed, and every fifth one of a user's taken out of its place."""
    from pyspark.sql import Window

    # Hashed once: what follows reads the events several times.
    own = written(chained(_events(spark, d)), folder(spark, "audit")).withColumn("n", F.row_number().over(Window.partitionBy("chain").orderBy("sequence")))
    own = own.withColumn("action", F.when(F.col("sequence") % 7 == 3, "tampered").otherwise(F.col("action")))
    # The fifth event was written anew, as if nothing came before it.
    alone = chained(own.filter("n = 5").drop("n", "hash", "previous_hash"))
    return verified(own.filter("n != 5").drop("n").unionByName(alone))
