"""Chains of audit events: appended with hashes over their canonical text and the hash before them, and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical_json import event_text
from ..shared import dealt
from ..shipping import ship

COLUMNS = ["actor_type", "actor", "action", "subject_type", "subject", "metadata"]


def chained(events: DataFrame, chain: str = "chain", sequence: str = "sequence", last: DataFrame | None = None) -> DataFrame:
    """events (chain, sequence, occurred, and COLUMNS) with previous_hash and hash, each chain in the order of sequence.
    last: (chain, hash) of chains that are continued. A hash needs the one before it, so a chain passes through one task,
    as a sorted stream; chains are independent."""
    ship(events.sparkSession)
    own = events if last is None else events.join(last.select(chain, F.col("hash").alias("start")), chain, "left")
    own = own.select(chain, sequence, "occurred", *COLUMNS, (F.col("start") if last is not None else F.lit(None).cast("string")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, previous, started = None, None, False
        for rows in batches:
            befores, hashes = [], []
            for r in rows.itertuples(index=False):
                if not started or r[0] != now:
                    now, previous, started = r[0], None if pd.isna(r[9]) else r[9], True
                befores.append(previous)
                previous = hashlib.sha256(event_text(previous, r[1], r[2], *r[3:9]).encode()).hexdigest()
                hashes.append(previous)
            yield rows.drop(columns="start").assign(previous_hash=befores, hash=hashes)

    kinds = dict(own.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own.columns[:-1]) + ", previous_hash string, hash string"
    return dealt(own, chain).sortWithinPartitions(chain, sequence).mapInPandas(run, schema)


def verified(events: DataFrame, chain: str = "chain", sequence: str = "sequence") -> DataFrame:
    """(chain, sequence, reason) of the first event of each chain that isn't what its hash says, or doesn't follow the one
    before it: 'content', 'sequence' or 'link'. Each event is read for itself; no chain is gathered."""
    from .runs import first_breaks

    ship(events.sparkSession)

    @F.pandas_udf("string")
    def digest(previous: pd.Series, n: pd.Series, occurred: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(event_text(None if pd.isna(p) else p, k, t, *own).encode()).hexdigest() for p, k, t, *own in zip(previous, n, occurred, *rest, strict=True)], dtype=object)

    wrong = events.filter(digest("previous_hash", sequence, "occurred", *COLUMNS) != F.col("hash")).groupBy(chain).agg(F.min(sequence).alias(sequence))
    broken = first_breaks(events, [chain], sequence, "hash", "previous_hash")
    both = wrong.select(chain, sequence, F.lit("content").alias("reason")).union(broken.select(chain, sequence, "reason"))
    return both.groupBy(chain).agg(F.min(F.struct(sequence, "reason")).alias("first")).select(chain, f"first.{sequence}", "first.reason")
