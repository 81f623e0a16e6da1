"""A directory of people and organisations that Spark derives from the given tables, row by row.

Expressions are plain SQL of both Spark and other engines, so that a test can derive the same rows on its own.
A customer is a person, its supplier an organisation; names, titles and addresses follow from the keys in a
few published forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRSTS = "Ana,José,Li,Mary,Omar,Zoë,Ivan,Ruth,Noor,Karl"
LASTS = "Smith,Núñez,Stone,Lee,Garcia,Fischer,Okafor,Dubois,Kim,Haddad,Weber"
TITLES = "Director of Finance,Asst. Director,SENIOR BUDGET ANALYST,City Manager,Executive Assistant,Librarian,Lead Custodian,Chief of Police,Wizard,Payroll Spec."
NBSP = " "


def pick(words: str, k: str) -> str:
    """The k-th, from 0, of comma-separated words."""
    return f"split_part('{words}', ',', CAST({k} AS INT) + 1)"


K = "c_custkey"
FORM = f"CAST({K} % 9 AS INT)"
FIRST = pick(FIRSTS, f"{K} % 10")
LAST = pick(LASTS, f"floor({K} / 10) % 11")
MIDDLE = f"substr('ABCDEFGHJK', CAST({K} % 7 AS INT) + 1, 1)"
RAW_NAME = f"""CASE {FORM} WHEN 0 THEN concat({FIRST}, ' ', {LAST}) WHEN 1 THEN concat({LAST}, ', ', {FIRST}, ' ', {MIDDLE}, '.')
WHEN 2 THEN concat('Dr. ', {FIRST}, ' ', {LAST}, ', Ph.D.') WHEN 3 THEN upper(concat({FIRST}, ' ', {LAST})) WHEN 4 THEN concat({FIRST}, ' van der ', {LAST})
WHEN 5 THEN concat({LAST}, ' Jr., ', {FIRST}) WHEN 6 THEN concat('  ', {FIRST}, '{NBSP} ', {MIDDLE}, '.  ', {LAST}, ' ') WHEN 7 THEN {LAST}
ELSE concat('Mr. ', {FIRST}, ' ', {MIDDLE}, '. ', {LAST}, ' III') END"""
ORG = f"CAST(floor({K} / 15) AS BIGINT)"
DOMAIN = f"concat('s', CAST({ORG} AS STRING), '.example.org')"
# ASCII forms of the names, as addresses have them.
ASCII = {"first": pick("ana,jose,li,mary,omar,zoe,ivan,ruth,noor,karl", f"{K} % 10"), "last": pick("smith,nunez,stone,lee,garcia,fischer,okafor,dubois,kim,haddad,weber", f"floor({K} / 10) % 11")}
#: Organisations keep one form of address, first.last or flast; every tenth person has none, every eleventh another.
ADDRESS = f"""CASE WHEN {K} % 10 = 9 THEN NULL ELSE concat(CASE WHEN {K} % 11 = 10 THEN concat('x', CAST({K} AS STRING)) WHEN {ORG} % 2 = 0 THEN concat({ASCII["first"]}, '.', {ASCII["last"]})
ELSE concat(substr({ASCII["first"]}, 1, 1), {ASCII["last"]}) END, '@', {DOMAIN}) END"""

#: name -> expression over customer.
PEOPLE = {
    "person": K,
    "org": ORG,
    "nation": "c_nationkey",
    "form": FORM,
    "first": FIRST,
    "middle": MIDDLE,
    "last": LAST,
    "raw_name": RAW_NAME,
    "title": pick(TITLES, f"floor({K} / 3) % 10"),
    "domain": DOMAIN,
    "address": ADDRESS,
}
PEOPLE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PEOPLE.items()) + " FROM customer"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*[f"{e} AS {n}" for n, e in PEOPLE.items()])
