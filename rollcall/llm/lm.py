"""LM scoring with a log-bilinear neural model.

Units are the MODEL_WORDS most frequent words, and for all others one of SUFFIXES classes by their last bytes.
The model guesses a unit's vector from the two before it, each through a matrix of its own, and scores every
unit by the product with its vector plus a bias. It learns by noise-contrastive estimation: each task goes
through all training texts of its partition in minibatches, against noise drawn by unit frequency, from one
common start; the models are added up in a tree and averaged by tokens. Scoring is normalised: scores add up
over the two places, so one matrix product of their exponentials, summed over all units, gives the normaliser
of every pair of units that can stand before another one, kept in a table of UNITS x UNITS. A word outside the
model has its class's probability times its own share there, (count + 1) / (class tokens + class words + 1).

Counts cover every training text. The HEAD most frequent words are sent to the tasks; counts of all others
are joined in, one row for each place where one stands. Each text is cut into units once, in a table that
training and scoring read; its rows are numbered, so repeated ids stay apart.

Edge cases: null and empty texts are the end token alone; with no training text every count is 0; a null id
counts as training; repeated rows count and are scored each for itself; words that are equally frequent are
ordered by their bytes; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, map_columns, map_rows

END = b""  # no word is empty
MODEL_WORDS, SUFFIXES = 1500, 256
HEAD, HEAD_BYTES = 200_000, 64  # words that tasks know, and their longest
SIZE, NOISE, STEP_TOKENS, RATE = 24, 32, 8192, 0.08
FLUSH = 250_000  # distinct words that a task counts before it passes them on
BATCH_TOKENS = 200_000
UNITS = MODEL_WORDS + 1 + SUFFIXES
SEED = 11


def held_out() -> Column:
    return F.coalesce(F.expr("crc32(cast(doc_id as string)) % 7 = 2"), F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), held_out().alias("held_out"))


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training texts, the end token as the empty word."""

    def run(rows):
        own: Counter = Counter()
        for _, text, _ in rows:
            own.update(text.lower().split())
            own[END] += 1
            if len(own) > FLUSH:
                yield list(own), list(own.values())
                own = Counter()
        if own:
            yield list(own), list(own.values())

    return map_columns(_texts(docs).filter(~F.col("held_out")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIXES


class Vocabulary:
    """What tasks know of words: sent as two arrays and a list."""

    def __init__(self, words: list[bytes], n: np.ndarray, class_size: np.ndarray, total: int, distinct: int):
        # words: the end token first, then by frequency
        self.words, self.n, self.class_size, self.total, self.distinct = words, n, class_size, total, distinct

    def __getstate__(self):
        return self.words, self.n, self.class_size, self.total, self.distinct

    def __setstate__(self, state):
        self.__init__(*state)

    def build(self) -> Vocabulary:
        if not hasattr(self, "at"):
            self.at = {w: k for k, w in enumerate(self.words)}
            k = np.arange(len(self.words))
            self.log_n = np.log10(self.n + 1.0)
            self.known = self.n > 0
            self.unit = np.where(k <= MODEL_WORDS, k, MODEL_WORDS + 1 + np.array([suffix_class(w) for w in self.words], np.int64))
            self.extra = np.where(k <= MODEL_WORDS, 0.0, self.log_n)
            self.log_class = np.log10(self.class_size + 1.0)
        return self

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(unit, index among the known words or -1) of each word and of the end token after them."""
        index = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        unit = self.unit[index]
        for k in np.flatnonzero(index < 0).tolist():
            unit[k] = MODEL_WORDS + 1 + suffix_class(words[k])
        return np.append(unit, 0), np.append(index, 0)


def vocabulary(counted: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the share of each unit, from (word, n)."""
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Whole steps of a logarithmic scale, from the top, while they hold HEAD words at most: no sort, few rows to the driver.
    short = counted.filter(f"length(word) between 1 and {HEAD_BYTES}").withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    least, held = 1 << 30, 0
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):
        if (held := held + r["count"]) > HEAD:
            break
        least = r.step
    top = short.filter(F.col("step") >= least).select("word", "n").collect()
    if len(top) < MODEL_WORDS:  # the next step alone holds more than HEAD words: the first of them by count and bytes
        top += short.filter(F.col("step") < least).select("word", "n").orderBy(F.desc("n"), "word").limit(MODEL_WORDS - len(top)).collect()
    top.sort(key=lambda r: (-r.n, bytes(r.word)))
    ends = counted.filter("length(word) = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [END] + [bytes(r.word) for r in top]
    n = np.array([ends] + [r.n for r in top], np.int64)
    last = F.when(F.length("word") <= 3, F.col("word")).otherwise(F.expr("substring(word, length(word) - 2, 3)"))
    by_class = counted.filter("length(word) > 0").groupBy((F.crc32(last) % SUFFIXES).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, kinds = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in by_class:
        tokens[r.k], kinds[r.k] = r.n, r.v
    for w, c in zip(words[1 : MODEL_WORDS + 1], n[1 : MODEL_WORDS + 1].tolist(), strict=False):
        k = suffix_class(w)
        tokens[k], kinds[k] = tokens[k] - c, kinds[k] - 1
    share = np.ones(UNITS)
    share[: min(len(n), MODEL_WORDS + 1)] += n[: MODEL_WORDS + 1]
    share[MODEL_WORDS + 1 :] += tokens
    return Vocabulary(words, n, tokens + kinds, int(total), int(distinct)), share / share.sum()


Params = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def start(share: np.ndarray) -> Params:
    """Vectors, the matrices of both places, biases."""
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.3, (UNITS, SIZE)).astype(np.float32)
    near, far = (np.eye(SIZE) * w + rng.normal(0, 0.05, (SIZE, SIZE)) for w in (0.4, 0.2))
    return vectors, near.astype(np.float32), far.astype(np.float32), np.log(share).astype(np.float32)


class Trainer:
    """Noise-contrastive steps over units in order."""

    def __init__(self, share: np.ndarray, params: Params, seed: int):
        self.params = [p.copy() for p in params]
        self.seen = [np.full(p.shape, 0.1, np.float32) for p in params]
        self.share, self.rng = share, np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.cumulated = np.cumsum(share)

    def step(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        vectors, near_m, far_m, bias = self.params
        n = len(word)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), UNITS - 1)
        v_near, v_far, v_word, v_noise = vectors[near], vectors[far], vectors[word], vectors[noise]
        guess = v_near @ near_m + v_far @ far_m
        own = np.einsum("ij,ij->i", guess, v_word) + bias[word] - self.log_noise[word]
        others = guess @ v_noise.T + (bias[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-others, -30, 30)))
        toward = up[:, None] * v_word + down @ v_noise
        where = np.concatenate([word, near, far])
        moves = np.concatenate([up[:, None] * guess, toward @ near_m.T, toward @ far_m.T])
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        g_vectors = np.zeros_like(vectors)
        g_vectors[where[first]] = np.add.reduceat(moves[order], first)
        np.add.at(g_vectors, noise, down.T @ guess)
        g_bias = np.bincount(word, up, UNITS).astype(np.float32)
        np.add.at(g_bias, noise, down.sum(0))
        for p, seen, g in zip(self.params, self.seen, (g_vectors, v_near.T @ toward, v_far.T @ toward, g_bias), strict=True):
            g = g / np.float32(n**0.5)
            seen += g * g
            p += RATE * g / np.sqrt(seen)

    def learn(self, units: np.ndarray) -> None:
        """units: whole texts laid end to end, each closed by the end token (0)."""
        near = np.concatenate([[0], units[:-1]])
        far = np.where(near == 0, 0, np.concatenate([[0, 0], units[:-2]]))
        order = self.rng.permutation(len(units))
        for k in range(0, len(order), STEP_TOKENS):
            at = order[k : k + STEP_TOKENS]
            self.step(units[at], near[at], far[at])


UNIT_SCHEMA = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, head double, rest double, units binary, rare array<binary>"


def unit_table(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """A row for each row of docs: its units as 16-bit numbers, sums over the words that tasks know, and all others."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(rows):
        known, key, held, size = sent.value.build(), TaskContext.get().partitionId() << 33, [], 0
        for doc_id, text, out in rows:
            own = text.lower().split()
            units, index = known.units(own)
            there = index >= 0
            at = index[there]
            outside = units[units > MODEL_WORDS] - MODEL_WORDS - 1
            rare = [own[k] for k in np.flatnonzero(~there).tolist()]
            rest = float(known.extra[at].sum() - known.log_class[outside].sum())
            held.append((key, doc_id, out, len(units), int(known.known[at].sum()), float(known.log_n[at].sum()), rest, units.astype("<u2").tobytes(), rare))
            key, size = key + 1, size + len(units)
            if size >= BATCH_TOKENS:
                yield list(zip(*held, strict=True))
                held, size = [], 0
        if held:
            yield list(zip(*held, strict=True))

    return kept(map_columns(_texts(docs), run, UNIT_SCHEMA), "units")


def _laid(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Rows in groups of BATCH_TOKENS units or so, and their units (the last column) end to end."""
    held, n = [], 0
    for *row, units in rows:
        held.append((*row, units))
        n += len(units) // 2
        if n >= BATCH_TOKENS:
            yield held, np.frombuffer(b"".join(r[-1] for r in held), "<u2").astype(np.int64)
            held, n = [], 0
    if held:
        yield held, np.frombuffer(b"".join(r[-1] for r in held), "<u2").astype(np.int64)


BLOCK = 4096
MODEL_SCHEMA = "block long, n long, sums array<double>"


def _added(models: DataFrame, at_once: int = 32) -> DataFrame:
    """The sums of each block, over few rows a block: a tree whose tasks add up at_once tasks' rows."""

    def run(rows):
        found: dict[int, list] = {}
        for block, n, sums in rows:
            own = found.setdefault(block, [0, 0.0])
            own[0] += n
            own[1] = own[1] + np.array(sums)
        yield from ((block, n, sums) for block, (n, sums) in found.items())

    while True:
        tasks = max(1, -(-models.rdd.getNumPartitions() // at_once))
        models = kept(map_rows(models.coalesce(tasks), run, MODEL_SCHEMA), "models")
        if tasks == 1:
            return models


def train(units: DataFrame, share: np.ndarray) -> Params:
    """The mean of the tasks' models, by tokens."""
    first = start(share)

    def run(rows):
        trainer = Trainer(share, first, SEED + TaskContext.get().partitionId())
        n = 0
        for _, own in _laid(rows):
            trainer.learn(own)
            n += len(own)
        if n:
            flat = np.concatenate([p.ravel() for p in trainer.params]).astype(float) * n
            for k in range(0, len(flat), BLOCK):
                yield k, n, flat[k : k + BLOCK]

    models = _added(kept(map_rows(units.filter(~F.col("held_out")).select("units"), run, MODEL_SCHEMA), "models"))
    flat = np.concatenate([p.ravel() for p in first]).astype(np.float64)
    for block, n, sums in models.collect():  # one row a block
        flat[block : block + len(sums)] = np.array(sums) / n
    out, at = [], 0
    for p in first:
        out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return tuple(out)


class Model:
    """Normalised log10 probabilities of units."""

    def __init__(self, params: Params):
        self.vectors, near, far, self.bias = params
        self.near, self.far = self.vectors @ near, self.vectors @ far
        # Scores add up over the places, so the sum over all units of their exponentials is a matrix product.
        one, two = (self.near @ self.vectors.T + self.bias).astype(float), (self.far @ self.vectors.T).astype(float)
        tops = one.max(1), two.max(1)
        sums = np.exp(one - tops[0][:, None]) @ np.exp(two - tops[1][:, None]).T
        self.normaliser = (np.log(sums) + tops[0][:, None] + tops[1]).astype(np.float32)

    def log10(self, units: np.ndarray) -> np.ndarray:
        """Of each of units: whole texts end to end, each closed by 0."""
        near = np.concatenate([[0], units[:-1]])
        far = np.where(near == 0, 0, np.concatenate([[0], near[:-1]]))
        guess = self.near[near] + self.far[far]
        score = np.einsum("ij,ij->i", guess, self.vectors[units]) + self.bias[units]
        return ((score - self.normaliser[near, far]) / np.log(10)).astype(np.float64)


def scored(docs: DataFrame) -> DataFrame:
    """Per document held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    counted = kept(counts(docs), "word-counts")
    words, share = vocabulary(counted)
    units = unit_table(docs, words)
    model = spark.sparkContext.broadcast(Model(train(units, share)))

    def run(rows):
        lm = model.value
        for held, own in _laid(rows):
            *same, sizes, rests, _ = zip(*held, strict=True)
            ends = np.cumsum(sizes)
            logs = np.add.reduceat(lm.log10(own), np.concatenate([[0], ends[:-1]]))
            yield [*same, sizes, np.array(rests) + logs]

    columns = ("key", "doc_id", "held_out", "n_known", "head", "n_tokens", "rest", "units")
    scores = map_columns(units.select(*columns), run, "key long, doc_id long, held_out boolean, n_known long, head double, n_tokens long, lm double")
    rare = units.select("key", F.explode("rare").alias("word")).join(counted, "word").groupBy("key").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("rare_log"))
    out = scores.join(rare, "key", "left").fillna(0, ["rare_known", "rare_log"])
    each = float(np.log10(words.total + words.distinct + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("rare_log") - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("lm") + F.col("rare_log")).alias("score"),
    )
