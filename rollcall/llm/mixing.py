"""Mixing sources to target weights by systematic sampling.

A source's target is its share by weight of all words, up to a cap times its own size; the excess goes to the sources
below their caps. Each document of a source then has the same expected number of copies, target / size. Along a
source's documents, in the order of their size, these expectations are summed; one random offset for the source is
added; a document is emitted once for each whole number that the sum crosses on it. Neighbours in size stand in for each
other, so that the words taken miss the target by about the size of the longest document at most.

Expectations are whole multiples of 2^-24, so sums are exact whatever the order of the tasks, and no document gets
more copies than the cap rounded up. Documents of a source lie in many tasks: places come from a sort by ranges.

Rows: a null text has no words; a null source is a source of its own, last; rows without an id and repeated rows are
documents each for itself; ties in size are broken by a hash of the id; a source without words has target 0 and takes
nothing, its documents no copies. An empty table gives none. Columns of any name pass through.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import placed
from .common import kept, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
SHARE = Fraction(1)  # of all words, that the mixture holds
CAP = 3  # times a source's size, the most that is taken of it
UNIT = 1 << 24  # parts of a copy
SEED = "mix"

_WHOLE = "decimal(38,0)"


def sized(docs: DataFrame, name: str = "size") -> DataFrame:
    """docs with the number of words of each text."""
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of (source, size), rows in any number for a source.

    All sources get the level that spends the budget by weight; those above their caps keep their caps, and the level
    rises for the others, until none is above. Each round is one aggregate over the sources; comparisons are in whole
    numbers.
    """
    sources = kept(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    own = placed(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    own = kept(own.select("source", "source_size", weight.alias("weight")), "mix-weights")
    most = F.col("source_size") * cap
    total, all_weights = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = min(total * share.numerator // share.denominator, total * cap)
    left, weighs, over = budget, all_weights, 0
    while True:
        above = F.col("weight").cast(_WHOLE) * F.lit(left).cast(_WHOLE) > most.cast(_WHOLE) * F.lit(weighs).cast(_WHOLE)
        n, spent, gone = own.filter(above).agg(F.count(F.lit(1)), F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == over:
            break
        over, left, weighs = n, budget - spent, all_weights - gone
    level = left / weighs if weighs else 0.0
    target = F.when(above, most.cast("double")).otherwise(F.col("weight").cast("double") * F.lit(level))
    return own.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A source's random offset, below UNIT: of its own name, so that reruns agree."""
    named = F.when(source.isNull(), F.lit(seed)).otherwise(F.concat(F.lit(f"{seed}:"), source))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 6), 16, 10).cast("long")


def allocated(docs: DataFrame, size: str, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, str, str, str]:
    """docs (doc_id, source, a size, and any others) with three columns more, and their names: the source's size, its
    target, and how many copies of the row the mixture has."""
    source_size, target, copies, place = unused(docs, "source_size", "target", "copies", "place")
    rows = kept(docs, "mix-sizes")
    per_source = targets(rows.select("source", F.col(size).alias("size")), weights, share, cap)
    expected = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5), F.lit(cap * UNIT))).otherwise(0)
    per_source = kept(per_source.withColumn("rate", expected.cast("long")).withColumn("start", offset(F.col("source"), seed)), "mix-rates")
    tie = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    ordered = placed(rows, [F.col(size), tie, F.col("doc_id")], place, ["source"])

    def crossed(k: Column) -> Column:
        """Whole numbers crossed on the first k documents."""
        return F.shiftright(k * per_source["rate"] + per_source["start"], 24)

    k = ordered[place]
    own = ordered.join(per_source, ordered["source"].eqNullSafe(per_source["source"]))
    drawn = own.select(*[ordered[f"`{c}`"] for c in docs.columns], per_source["source_size"].alias(source_size), per_source["target"].alias(target), (crossed(k) - crossed(k - 1)).alias(copies))
    return drawn, source_size, target, copies


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture itself: rows of docs, each as often as it was drawn."""
    (size,) = unused(docs, "size")
    rows, _, _, copies = allocated(sized(docs, size), size, weights, share, cap, seed)
    again = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return rows.filter(F.col(copies) > 0).withColumn(copies, again).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    own = sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size")
    rows, source_size, target, copies = allocated(own, "size")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", source_size, target, (F.col(copies) * F.col("size")).alias("taken"))
