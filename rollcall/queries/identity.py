"""Identity of organisations over tiers of evidence: orders as arrivals of records about their customers."""

from __future__ import annotations

from ..operators.identity import TIERS, conflicting, folded, resolved
from .base import query, table

#: One arrival an order; evidence comes and goes, neighbours share a tax number, so that chains form.
ARRIVALS = """SELECT o_orderkey AS record, o_orderdate AS observed, CASE WHEN o_orderkey % 4 = 0 THEN 'tax' END AS identifier_system,
CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 6 > 1 THEN concat('S', CAST(CAST(floor(o_custkey / 2) AS BIGINT) % 4 AS STRING)) END AS identifier_state,
CASE WHEN o_orderkey % 4 = 0 THEN concat('C ', CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS STRING), CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE '' END) END AS identifier_value,
CASE WHEN o_orderkey % 3 = 0 THEN 'erp' END AS source_system, CASE WHEN o_orderkey % 3 = 0 THEN concat(CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'a' END, CAST(o_custkey AS STRING)) END AS source_value,
CASE WHEN o_orderkey % 5 < 2 THEN concat('p', CAST(o_custkey % 7 AS STRING)) END AS parent, CASE WHEN o_orderkey % 11 <> 0 THEN concat('j', CAST(o_custkey % 5 AS STRING)) END AS jurisdiction,
CASE WHEN o_orderkey % 2 = 0 THEN concat('s', CAST(CAST(floor(o_custkey / 10) AS BIGINT) AS STRING), '.example.org') END AS domain, concat('t', CAST(o_custkey % 3 AS STRING)) AS type,
concat('org-', CAST(o_custkey AS STRING)) AS name_key, concat('d', CAST(o_orderkey % 50 AS STRING)) AS document, concat('Org ', CAST(o_custkey AS STRING), ' ', o_orderpriority) AS name,
CASE WHEN o_orderstatus <> 'P' THEN concat('http://', CAST(o_orderkey AS STRING), '.example.org/') END AS website, o_orderstatus AS method, o_totalprice / 1000000 AS confidence FROM {orders}"""

_SQL = f"""WITH RECURSIVE a AS ({ARRIVALS.format(orders="orders")}),
e AS (SELECT record, 4 AS tier, 'oid:' || identifier_system || ':' || coalesce(identifier_state || ':', '') || identifier_value AS fp FROM a WHERE identifier_value IS NOT NULL
UNION ALL SELECT record, 3, 'sid:' || source_system || ':' || source_value FROM a WHERE source_value IS NOT NULL
UNION ALL SELECT record, CASE WHEN parent IS NOT NULL THEN 2 WHEN domain IS NOT NULL AND jurisdiction IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN parent IS NOT NULL THEN 'psn:' || coalesce(jurisdiction, '-') || ':' || parent
WHEN domain IS NOT NULL AND jurisdiction IS NOT NULL THEN 'dsn:' || jurisdiction || ':' || domain ELSE 'amb:' || document END || ':' || type || ':' || name_key FROM a),
k AS (SELECT DISTINCT record, regexp_replace(lower(trim(fp)), '\\s+', ' ', 'g') AS fp FROM e), s AS (SELECT record, min(record) OVER (PARTITION BY fp) AS hub FROM k),
b AS (SELECT DISTINCT record AS x, hub AS y FROM s UNION SELECT DISTINCT hub, record FROM s),
r AS (SELECT record AS node, record AS other FROM a UNION SELECT b.y, r.other FROM r JOIN b ON b.x = r.node),
c AS (SELECT node AS record, min(other) AS organization FROM r GROUP BY 1),
o AS (SELECT a.*, organization, t.tier, t.fp AS fingerprint FROM a JOIN c USING (record) JOIN (SELECT record, max(tier) AS tier, arg_max(fp, tier) AS fp FROM e GROUP BY 1) t USING (record))"""

_BEFORE = "OVER (PARTITION BY organization ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NAMES = "CASE max(tier) " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TIERS)) + " END"


def _arrivals(spark, d):
    return spark.sql(ARRIVALS.format(orders="{orders}"), orders=table(spark, d, "orders"))


@query(f"""{_SQL}, f AS (SELECT *, tier >= coalesce(max(tier) {_BEFORE}, 0) AS ok, max(observed) {_BEFORE} AS seen FROM o)
SELECT organization, arg_max(name, record) FILTER (WHERE ok AND (seen IS NULL OR observed >= seen)) AS name, arg_max(method, record) FILTER (WHERE ok) AS method, arg_max(type, record) FILTER (WHERE ok) AS type,
arg_max(website, record) FILTER (WHERE ok AND website IS NOT NULL) AS website, arg_max(domain, record) FILTER (WHERE ok AND domain IS NOT NULL) AS domain, arg_max(jurisdiction, record) FILTER (WHERE ok AND jurisdiction IS NOT NULL) AS jurisdiction,
max(confidence) FILTER (WHERE ok) AS confidence, arg_min(observed, record) AS first_seen, max(observed) AS last_seen, {_NAMES} AS identity_tier, arg_max(fingerprint, (tier, -record)) AS identity_fingerprint, max(tier) = 0 AS needs_review FROM f GROUP BY 1""")
def m7_organizations(spark, d):
    """Records merged over chains of evidence, and folded so that only evidence as strong as any before changes them."""
    return folded(resolved(_arrivals(spark, d)), ["method", "type"], ["website", "domain", "jurisdiction"])


@query(f"""{_SQL} SELECT organization, identifier_system, identifier_state, count(DISTINCT identifier_value) AS identifiers FROM o WHERE identifier_value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT identifier_value) > 1""")
def m7_identity_conflicts(spark, d):
    """Organisations whose evidence names several identifiers of one system."""
    return conflicting(resolved(_arrivals(spark, d)))
