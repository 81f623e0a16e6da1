"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of five words, as 64-bit hashes. Documents with equal sets form a
class; the smallest id stands for it. Representatives get SAMPLES MinHash samples, cut into bands, and an odd
sketch: each sample flips one bit of a bitmap, so the bits in which two bitmaps differ estimate how many
samples differ, most precisely at high similarity. The sketch rules out band partners that are clearly too
far; every link is then confirmed on the full sets.

No bucket is ever paired with itself. In each round the bucket's members are first compared with its smallest
one. What is then already connected needs no more links: only buckets in which several components meet go
on. Small ones (up to SMALL members) are paired in full. In larger ones, members outside the first one's
component meet only those that share one of their rarest shingles with them (a prefix filter, which is exact).

Edge cases: a row without an id keeps its own place, linked with nothing; null and empty texts have an empty set and are
linked with nothing; texts of fewer than five words are one shingle; rows with equal ids are one document, whatever their
texts: each text takes part with its own set, all links of an id's texts are the document's, and each row is returned
with its own set's size; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_rows, texts

WORDS, THRESHOLD = 5, 75  # shingle length; percent
BANDS, ROWS = 36, 5
SAMPLES = BANDS * ROWS
BITS = 1024  # of an odd sketch
SKETCH_LEAST = 0.6  # an estimate below this cannot be a link; more than four standard deviations away
SMALL = 24
CELL_BITS = 20
CELLS = 1 << CELL_BITS  # of the table that orders shingles by how frequent they are
MEMO = 250_000

_RNG = np.random.default_rng(20240601)
FACTOR = _RNG.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash, for the last MEMO words or so."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    get = _hashes.__getitem__
    h = np.fromiter(map(get, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, min(len(words), WORDS), np.uint64)
    for k in range(min(WORDS, len(words))):
        out = (out ^ (h[k : k + n] * MIX[k])) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhash(items: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 2000):
        part = items[k : k + 2000]
        np.minimum(low, (part[None, :] * FACTOR[:, None] + OFFSET[:, None]).min(1), out=low)
    return low


def bands(low: np.ndarray) -> list[int]:
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(rows[k].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)]


def odd_sketch(low: np.ndarray) -> bytes:
    """A bitmap in which each (sample, value) flips one bit."""
    mixed = (low + np.arange(SAMPLES, dtype=np.uint64) * MIX[0]) * MIX[1]
    at = (mixed >> np.uint64(40)) % np.uint64(BITS)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def similarity(differ: int) -> float:
    """The Jaccard similarity that an odd sketch's differing bits suggest."""
    left = max(1 - 2 * differ / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * float(np.log(left))


#: Differing bits at most for a pair that is still confirmed on full sets.
MOST_BITS = next(k for k in range(BITS) if similarity(k) < SKETCH_LEAST)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands, sketch); no bands for empty sets."""

    def run(rows):
        for doc_id, text in rows:
            items = shingles(text)
            if len(items):
                low = minhash(items)
                yield doc_id, len(items), xxhash.xxh3_128_digest(items.tobytes()), bands(low), odd_sketch(low)
            else:
                yield doc_id, 0, b"", [], b""

    return map_rows(texts(docs), run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, total) of candidate pairs on full sets, for those with 100 * shared >= percent * total."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = kept(texts(docs).join(ids, "doc_id", "left_semi"), "texts-to-confirm")
    left = needed.withColumnsRenamed({"doc_id": "a", "text": "text_a"})
    right = needed.withColumnsRenamed({"doc_id": "b", "text": "text_b"})

    def run(rows):
        last, set_b = None, None
        for a, b, text_a, text_b in rows:
            if b != last:
                last, set_b = b, shingles(text_b)
            set_a = shingles(text_a)
            shared = len(np.intersect1d(set_a, set_b, assume_unique=True))
            total = len(set_a) + len(set_b) - shared
            if 100 * shared >= percent * total:
                yield a, b, shared, total

    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return map_rows(rows, run, "a long, b long, shared long, total long").dropDuplicates(["a", "b"])


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches don't rule a link out."""
    words = BITS // 64
    s = sketches.select("doc_id", *[F.conv(F.hex(F.substring("sketch", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"w{k}") for k in range(words)])
    a = s.withColumnsRenamed({"doc_id": "a"} | {f"w{k}": f"a{k}" for k in range(words)})
    b = s.withColumnsRenamed({"doc_id": "b"} | {f"w{k}": f"b{k}" for k in range(words)})
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(words)), F.lit(0))
    return pairs.join(a, "a").join(b, "b").select("a", "b", differ.alias("differ")).filter(F.col("differ") <= MOST_BITS)


def _cell_counts(held: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each of CELLS cells: a table of fixed size."""

    def run(rows):
        cells, size = [], 0

        def sums():
            found, n = np.unique(np.concatenate(cells), return_counts=True)
            yield from zip(found.tolist(), n.tolist(), strict=True)

        for (text,) in rows:
            cells.append(_cells(shingles(text)))
            size += len(cells[-1])
            if size > CELLS:
                yield from sums()
                cells, size = [], 0
        if cells:
            yield from sums()

    parts = map_rows(held.select("text"), run, "cell long, n long")
    got = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _cells(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sharing_rare(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (doc_id, comp, outside) of different components, one of them outside, that can be linked.

    All sets are put in one order, shingles of rare cells first. Two linked sets meet early in it: their first common
    shingle lies in the first n - ceil(percent * n / 100) + 1 of each, and leaves enough behind it for the overlap
    that a link needs. This holds in any order, so cells that several shingles share lose no link. A member whose
    own rare shingles fill that prefix meets nobody, however many members its buckets have.
    """
    spark = docs.sparkSession
    held = kept(texts(docs).join(members, "doc_id").select("doc_id", "comp", "outside", "text"), "texts-of-members")
    counts = spark.sparkContext.broadcast(_cell_counts(held))

    def run(rows):
        for doc_id, comp, outside, text in rows:
            items = shingles(text)
            often = counts.value[_cells(items)]
            order = np.lexsort((items, often))[: len(items) - -(-percent * len(items) // 100) + 1]
            for at, k in enumerate(order.tolist()):
                if often[k] > 1:  # else no other set has it
                    yield doc_id, comp, outside, len(items), at, int(items[k]) - (1 << 63)

    early = kept(map_rows(held, run, "doc_id long, comp long, outside long, n long, at long, shingle long"), "early-shingles")
    x = early.filter("outside = 1").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "comp", "n", "at")])
    y = early.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "comp", "n", "at")])
    enough = F.expr(f"({100 + percent}) * (least(n_x - at_x, n_y - at_y)) >= {percent} * (n_x + n_y)")
    met = x.join(y, "shingle").filter((F.col("comp_x") != F.col("comp_y")) & enough)
    return met.select(F.greatest("doc_id_x", "doc_id_y").alias("a"), F.least("doc_id_x", "doc_id_y").alias("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    """Count, sums and hash of distinct edges: equal only for equal sets, but for a chance of about 2^-64."""
    return tuple(edges.agg(F.count("*"), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, comp): the smallest id reachable, for every node of edges (a, b) and of before, an earlier result.

    New edges only meet between earlier components, so stars are drawn on those and the rest follows by one join.
    """
    ends = edges.select("a", "b")
    if before is not None:
        for x in "ab":
            top = before.select(F.col("node").alias(x), F.col("comp").alias("top"))
            ends = ends.join(top, x, "left").withColumn(x, F.coalesce("top", x)).drop("top")
    both = kept(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    now = _print(both)
    while True:
        # Every node's neighbours point to the smallest of them, larger ones first, then smaller ones.
        wide = both.select("u", "v").union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = wide.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = wide.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        both, last = kept(small, "edges"), now
        now = _print(both)
        if now == last:
            break
    tops = both.select(F.col("v").alias("node")).distinct()
    found = both.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(tops.select("node", F.col("node").alias("comp")))
    if before is None:
        return found
    up = found.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    moved = before.join(up, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))
    return moved.union(found.join(before.select("node"), "node", "left_anti").select("node", "comp"))


SALTS = 16  # tasks over which the members of one bucket are dealt


def _beside(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows joined by bucket with a table of one row a bucket; members of a large bucket are dealt over SALTS tasks. Only
    buckets with several members have a row, so that repeating it for each salt costs little."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, ["bucket", "salt"]).drop("salt")


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def _of_sets(docs: DataFrame, several: DataFrame, alone: DataFrame) -> DataFrame:
    """(doc_id, text) as docs, without the ids in `several`, and with a text for each set of `alone` under its number."""

    def run(rows):
        for doc_id, text in rows:
            items = shingles(text)
            if len(items):
                yield xxhash.xxh3_128_digest(items.tobytes()), text

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mine = map_rows(texts(own.join(several, "doc_id", "left_semi")), run, "set_hash binary, text binary").join(alone, "set_hash").dropDuplicates(["rep"])
    return own.join(several, "doc_id", "left_anti").union(mine.select(F.col("rep").alias("doc_id"), F.col("text").cast("string")))


def _crossed(held: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """whole (set_hash, comp) with components joined that one id (doc_id, set_hash) has sets of, and the smallest id of
    each component, which may be such a one; and (doc_id, id) of these ids."""
    at = kept(held.join(whole, "set_hash").select("doc_id", "comp").distinct(), "components-of-such-ids")
    first = at.groupBy("doc_id").agg(F.min("comp").alias("first"))
    ups = kept(components(at.join(first, "doc_id").select(F.col("comp").alias("a"), F.col("first").alias("b"))), "components-joined").withColumnRenamed("comp", "up")
    at = at.join(ups, F.col("comp") == F.col("node"), "left").select("doc_id", F.coalesce("up", "comp").alias("up"))
    names = kept(at.groupBy("up").agg(F.min("doc_id").alias("least")).select("up", F.least("up", "least").alias("id")), "names-of-components")
    moved = whole.join(ups, F.col("comp") == F.col("node"), "left").select("set_hash", F.coalesce("up", "comp").alias("up"))
    return moved.join(names, "up", "left").select("set_hash", F.coalesce("id", "up").alias("comp")), at.join(names, "up").select("doc_id", "id").distinct()


def linked(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    signed = kept(signatures(docs), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # Ids that come with several sets, an empty one among them or not, stand for none of them: sets that nobody else has get a number beyond all ids.
    several = kept(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).filter("low != high").select("doc_id"), "ids-of-several-texts")
    crossed = not several.isEmpty()
    single = full.join(several, "doc_id", "left_anti") if crossed else full
    classes = kept(single.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    reps = single.join(classes, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "bands", "sketch").dropDuplicates(["doc_id"])
    if crossed:
        mixed = kept(full.join(several, "doc_id", "left_semi"), "sets-of-such-ids")
        beyond = full.agg(F.max("doc_id")).first()[0] + 1
        alone = mixed.join(classes, "set_hash", "left_anti").dropDuplicates(["set_hash"])
        alone = kept(alone.withColumn("rep", F.monotonically_increasing_id() + F.lit(beyond)), "sets-of-such-ids-alone")
        reps = reps.union(alone.select("rep", "bands", "sketch"))
        classes = classes.union(alone.select("set_hash", "rep"))
        docs = _of_sets(docs, several, alone.select("set_hash", "rep"))
    reps = kept(reps, "representatives")
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    rows = kept(_beside(rows, firsts), "buckets")

    def confirm(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Components with the links among pairs; each document's most likely partner comes first, the rest only
        where it still joins components."""
        likely = kept(_likely(pairs, reps), "likely-pairs")
        best = likely.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        for first in (True, False):
            some = best if first else likely.select("a", "b")
            if comps is not None:
                ca, cb = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
                some = some.join(ca, "a", "left").join(cb, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
            some = kept(some, "pairs")
            if comps is not None and some.isEmpty():
                continue
            new = kept(_confirmed(docs, some, percent).select("a", "b"), "links")
            if comps is None or not new.isEmpty():
                comps = kept(components(new, comps), "components")
        return comps

    # Round 1: each bucket's members and its smallest one.
    stars = rows.filter("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    comps = confirm(stars, None)

    # Round 2: small buckets in which several components meet, in full.
    def meeting(rows: DataFrame, comps: DataFrame) -> DataFrame:
        now = _labelled(rows.select("doc_id", "bucket", "first", "size"), comps)
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("bucket")
        return _beside(now, mixed)

    left = kept(meeting(rows, comps), "meeting")
    few = left.filter(F.col("size") <= SMALL)
    x, y = few.select("bucket", F.col("doc_id").alias("a"), F.col("comp").alias("ca"), "first"), few.select("bucket", F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
    pairs = x.join(y, "bucket").filter("a > b and ca != cb and b != first").select("a", "b").distinct()
    comps = confirm(pairs, comps)

    # Round 3: large buckets in which components meet. Members outside their bucket's first component are held
    # against the others that share a rare shingle with them.
    many = meeting(left.filter(F.col("size") > SMALL).drop("comp"), comps)
    many = many.join(comps.select(F.col("node").alias("first"), F.col("comp").alias("home")), "first", "left").withColumn("home", F.coalesce("home", "first"))
    members = kept(many.groupBy("doc_id").agg(F.first("comp").alias("comp"), F.max((F.col("comp") != F.col("home")).cast("long")).alias("outside")), "members")
    if not members.isEmpty():
        comps = confirm(_sharing_rare(docs, members, percent), comps)

    whole = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"))
    if crossed:
        whole, own_ids = _crossed(mixed.select("doc_id", "set_hash").distinct(), kept(whole, "whole"))
    # Rows without a set or an id are linked with nothing and take no part in the join.
    has = "n_shingles > 0 and doc_id is not null"
    out = signed.filter(has).select("doc_id", "n_shingles", "set_hash").join(whole, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    bare = signed.filter(f"not ({has})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if crossed:
        bare = bare.join(own_ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("id", "component_id").alias("component_id"))
    out = out.union(bare)
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
