"""Addresses: found in texts, decoded from derived forms, classified, and learned from."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..directory import PEOPLE_SQL, people
from ..functions import emails as E
from ..functions import names as N
from ..operators import patterns as P
from ..shared import spread
from .base import query, table
from .people import PARTS
from .text import sql_key

SQL_PLAIN = r"[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"


@query(f"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{SQL_PLAIN}'), lambda a: lower(a)))) AS addresses FROM documents WHERE regexp_matches(text, '{SQL_PLAIN}')""")
def x34_addresses_in_texts(spark, d):
    found = F.array_sort(E.plain_addresses(F.col("text")))
    return table(spark, d, "documents").select("doc_id", found.alias("addresses")).filter(F.size("addresses") > 0)


@query("""SELECT c_custkey, c_custkey % 6 IN (0, 1) AS valid FROM customer""")
def x30_syntax(spark, d):
    k = F.col("c_custkey").cast("string")
    n = F.col("c_custkey") % 6
    raw = F.when(n == 0, F.concat(F.lit("a.b+c"), k, F.lit("@x-y.org"))).when(n == 1, F.concat(F.lit("A"), k, F.lit("@M.EXAMPLE.ORG"))).when(n == 2, F.concat(F.lit("a..b"), k, F.lit("@x.org")))
    raw = raw.when(n == 3, F.concat(k, F.lit("@x@y.org"))).when(n == 4, F.concat(k, F.lit("@-x.org"))).otherwise(F.concat(F.repeat(F.lit("a"), 65), F.lit("@x.org")))
    return table(spark, d, "customer").select("c_custkey", E.is_valid(raw).alias("valid"))


ADDRESS_SQL = f"SELECT person, address FROM ({PEOPLE_SQL}) WHERE address IS NOT NULL"


@query(f"""SELECT person, address AS entities, address AS cloudflare, address AS spelled, address AS bracketed, address AS mailto, 'plain' AS form FROM ({ADDRESS_SQL})""")
def x31_x35_decoded(spark, d):
    """Each address hidden in five ways and found again."""
    a = F.col("address")
    letters = F.split(a, "")
    own = spread(people(spark, d).filter("address is not null").select("person", "address"))
    entities = F.array_join(F.transform(letters, lambda x, k: F.when(k % 3 == 0, F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).when(k % 3 == 1, F.concat(F.lit("&#x"), F.hex(F.ascii(x)), F.lit(";"))).otherwise(x)), "")
    hidden = F.lower(F.concat(F.lit("5A"), F.array_join(F.transform(letters, lambda x: F.lpad(F.hex(F.ascii(x).bitwiseXOR(F.lit(0x5A))), 2, "0")), "")))
    spelled = F.replace(F.replace(a, F.lit("."), F.lit(" dot ")), F.lit("@"), F.lit(" at "))
    bracketed = F.replace(F.replace(a, F.lit("."), F.lit(" [dot] ")), F.lit("@"), F.lit("[at]"))
    mail = F.concat(F.lit(" MAILTO:"), F.replace(a, F.lit("@"), F.lit("%40")), F.lit("?subject=x"))
    whole = F.concat(F.lit("Write to: "), spelled, F.lit(". Thanks"))
    found = E.addresses(F.concat(F.lit("<"), entities, F.lit(">")))[0].alias("found")
    rows = own.select("person", found, E.cloudflare(hidden).alias("cloudflare"), E.spelled_addresses(whole)[0].alias("spelled"), E.spelled_addresses(bracketed)[0].alias("bracketed"), E.of_mailto(mail).alias("mailto"))
    return rows.select("person", F.col("found.address").alias("entities"), "cloudflare", "spelled", "bracketed", "mailto", F.col("found.form").alias("form"))


@query(f"""SELECT person, CASE person % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'general_inbox' WHEN 2 THEN 'inferred_candidate' WHEN 3 THEN 'published' ELSE 'decoded_published' END AS kind, person % 7 = 0 AS personal FROM ({PEOPLE_SQL})""")
def x36_x38_classes(spark, d):
    n = F.col("person") % 5
    k = F.col("person").cast("string")
    a = F.when(n == 0, F.concat(F.lit("a@b@c"), k)).when(n == 1, F.concat(F.lit("Front-Office"), F.substring(k, -2, 2), F.lit("@"), "domain")).otherwise(F.concat(F.lit("x"), k, F.lit("@"), "domain"))
    shown, inferred = F.col("person") % 5 == 3, n == 2
    host = F.when(F.col("person") % 7 == 0, " GMail.com ").otherwise(F.col("domain"))
    return people(spark, d).select("person", E.kind(a, shown, inferred, F.lit(False)).alias("kind"), E.is_personal(host).alias("personal"))


#: Names in all their forms as tokens, and the local part that each pattern gives for them.
_TOKEN = {k: f"coalesce(replace({sql_key(k)}, '-', ''), '')" for k in ("first", "middle", "last")}
_TOKENS = f"""SELECT p.person, p.org, p.domain, p.address, split_part(p.address, '@', 1) AS local, {", ".join(f"n.{k}" for k in _TOKEN)} FROM ({PEOPLE_SQL}) p
JOIN (SELECT person, {", ".join(f"{e} AS {k}" for k, e in _TOKEN.items())} FROM ({PARTS})) n ON n.person = p.person"""


def _rendered(pattern: str) -> str:
    parts = [x for x in re.split(r"\{(\w+)\}", pattern)]
    own = {"first": "first", "middle": "middle", "last": "last", "f": "substr(first, 1, 1)", "m": "substr(middle, 1, 1)", "l": "substr(last, 1, 1)"}
    return " || ".join(f"nullif({own[x]}, '')" if k % 2 else f"'{x}'" for k, x in enumerate(parts) if k % 2 or x)


_MATCHING = "list_filter([" + ", ".join(f"CASE WHEN {_rendered(p)} = local THEN '{p}' END" for p in E.PATTERNS) + "], lambda x: x IS NOT NULL)"
_LETTERS = "regexp_replace(local, '[^a-z]', '', 'g')"


@query(f"""SELECT person, len({_MATCHING}) AS matching, length({_LETTERS}) >= 3 AND (length(last) >= 3 AND contains({_LETTERS}, last) OR length(first) >= 3 AND contains({_LETTERS}, first)) AS named FROM ({_TOKENS}) WHERE address IS NOT NULL""")
def x37_x39_patterns(spark, d):
    own = _pairs(spark, d).filter("address is not null")
    local = E.local_part(F.col("address"))
    return own.select("person", F.size(E.matching_patterns(local, F.col("tokens"))).alias("matching"), E.names_person(local, F.col("tokens")).alias("named"))


LEARNED = f"""SELECT domain, pattern, count(*) AS support, max(total) - count(*) AS conflicts, CAST(count(*) AS DOUBLE) / max(total) AS consistency FROM
(SELECT domain, unnest({_MATCHING}) AS pattern, total FROM (SELECT *, count(*) OVER (PARTITION BY domain) AS total FROM ({_TOKENS}) WHERE address IS NOT NULL)) GROUP BY 1, 2 HAVING count(*) >= 3 AND CAST(count(*) AS DOUBLE) / max(total) >= 0.5"""


def _pairs(spark, d):
    own = people(spark, d).withColumn("name", N.parse(spark, F.col("raw_name")))
    return own.withColumn("tokens", N.tokens(F.col("name")))


@query(LEARNED)
def a17_learned_patterns(spark, d):
    """Patterns that explain half of a domain's addresses: names come in nine forms, some without a first name."""
    pairs = _pairs(spark, d).filter("address is not null")
    return P.learned(pairs, "address", "tokens", least_consistency=0.5).select("domain", "pattern", "support", "conflicts", "consistency")


_CASES = " ".join(f"WHEN '{p}' THEN {_rendered(p)}" for p in E.PATTERNS)


@query(f"""SELECT person, candidate || '@' || domain AS candidate, least(0.95, floor(consistency * (0.75 + 0.25 * least(1.0, support / 20.0)) * 100 + 0.5) / 100) AS confidence FROM (SELECT person, t.domain, CASE pattern {_CASES} END AS candidate, consistency, support
FROM ({_TOKENS}) t JOIN (SELECT * FROM ({LEARNED}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY consistency DESC, support DESC, pattern) = 1) l ON l.domain = t.domain WHERE address IS NULL) WHERE candidate IS NOT NULL""")
def e14_x40_candidates(spark, d):
    """Addresses for people without one, by the best pattern of their domain."""
    own = _pairs(spark, d)
    learned = P.learned(own.filter("address is not null"), "address", "tokens", least_consistency=0.5)
    return P.candidates(own.filter("address is null"), learned, "domain", "tokens").select("person", "candidate", "confidence")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal > 5000 THEN 'promoted' ELSE 'candidate' END AS state, c_acctbal > 5000 AND c_custkey % 2 = 0 AS promote FROM customer""")
def x41_m13_validation(spark, d):
    result = F.when(F.col("c_acctbal") < 0, "invalid").when(F.col("c_acctbal") > 5000, "valid").otherwise("unknown")
    c = table(spark, d, "customer").withColumn("result", result)
    return c.select("c_custkey", P.state_after(F.col("result"), F.lit("candidate")).alias("state"), P.may_promote(F.col("result"), F.when(F.col("c_custkey") % 2 == 0, 0.9).otherwise(0.5)).alias("promote"))
