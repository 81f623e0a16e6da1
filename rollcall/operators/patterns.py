"""Learning how a domain forms its addresses, and candidates from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails as E
from .latest import best_of

LEAST_SUPPORT, LEAST_CONSISTENCY, EXAMPLES = 3, 0.8, 10


def learned(pairs: DataFrame, address: str, tokens: str, least_support: int = LEAST_SUPPORT, least_consistency: float = LEAST_CONSISTENCY) -> DataFrame:
    """(domain, pattern, support, conflicts, consistency, examples): patterns that explain enough of a domain's
    published addresses. One aggregation by domain and pattern, and its totals by domain; examples are the first
    EXAMPLES addresses by name."""
    own = pairs.select(E.domain(F.col(address)).alias("domain"), F.lower(address).alias("address"), E.matching_patterns(E.local_part(F.col(address)), F.col(tokens)).alias("patterns"))
    totals = own.groupBy("domain").agg(F.count("*").alias("total"))
    each = own.select("domain", "address", F.explode("patterns").alias("pattern"))
    first = best_of(each, ["domain", "pattern"], [F.col("address")], EXAMPLES).groupBy("domain", "pattern").agg(F.array_sort(F.collect_list("address")).alias("examples"))
    found = each.groupBy("domain", "pattern").agg(F.count("*").alias("support")).join(first, ["domain", "pattern"])
    out = found.join(totals, "domain").withColumn("consistency", F.col("support") / F.col("total")).withColumn("conflicts", F.col("total") - F.col("support"))
    return out.filter((F.col("support") >= least_support) & (F.col("consistency") >= least_consistency)).drop("total")


def candidates(people: DataFrame, patterns: DataFrame, domain: str, tokens: str) -> DataFrame:
    """people with the address that their domain's best pattern gives (candidate) and its confidence; people for whom
    it can't be rendered, or not validly, go."""
    best = best_of(patterns, ["domain"], [F.desc("consistency"), F.desc("support"), F.col("pattern")])
    own = people.join(best.select(F.col("domain").alias(domain), "pattern", "support", "consistency"), domain)
    local = F.when(F.lit(False), "")
    for p in E.PATTERNS:
        local = local.when(F.col("pattern") == p, E.rendered(p, F.col(tokens)))
    made = own.withColumn("candidate", F.concat(local, F.lit("@"), F.col(domain))).withColumn("confidence", E.inference_confidence(F.col("consistency"), F.col("support")))
    return made.filter(E.is_valid(F.col("candidate")))


def state_after(result: Column, state: Column) -> Column:
    """A candidate's state after a validation: promoted, rejected, or as it was."""
    return F.when(result == "valid", "promoted").when(result == "invalid", "rejected").otherwise(state)


def may_promote(result: Column, confidence: Column, least: float = 0.8) -> Column:
    return F.coalesce((result == "valid") & (confidence >= least), F.lit(False))
