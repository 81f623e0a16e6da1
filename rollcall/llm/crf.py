"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line gets features of its own and of the lines beside it; the chain labels lines good or bad. It learns
from texts' labels, each line with its text's label, on a bounded sample of whole texts: labelled rows of the
training part in the order of a hash of the id, at most SAMPLE of them, until SAMPLE_LINES lines are spent (a
text that no longer fits is passed over). The chain of a text is learned in windows of WINDOW lines, which
together hold all of its lines. A text's score is the mean of its lines' forward-backward marginals over the
whole text, weighted by line length. Only the text is an input.

Edge cases: null and empty texts are one empty line and get its score; without any labels every score is 0.5;
null labels are left out; if an id has several labels or texts, each counts, and equal rows once; equal hashes are ordered by id and label;
repeated rows are scored each for itself; a null id is no held-out one; other columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, kept, map_rows, texts

SAMPLE, SAMPLE_LINES, WINDOW = 4000, 300_000, 256  # labelled rows, lines of all their texts, lines of a window
STEPS, RATE, DECAY = 150, 0.1, 1e-3
TOP_WORDS = 300
SYMBOLS, STOPS = b"#*$%&|<>", b".,;:!?)\"'"
OWN = 12  # features of a line itself
BESIDE = (1, 2, 4, 5, 6, 10)  # of these, the lines before and after give theirs too
GOOD_FROM = 0.3


def _classes() -> np.ndarray:
    """By byte: 1 lower, 2 upper, 3 digit, 4 symbol, 0 others."""
    out = np.zeros(256, np.uint8)
    for k, chars in ((1, [*range(97, 123), *range(128, 256)]), (2, range(65, 91)), (3, range(48, 58)), (4, SYMBOLS)):
        out[[*chars]] = k
    return out


CLASS_OF = _classes()


def line_features(text: bytes, common: frozenset[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths)."""
    lines = text.split(b"\n")
    size = np.array([len(x) + 1 for x in lines])
    kind = CLASS_OF[np.frombuffer(text + b"\n", np.uint8)]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    lower, upper, digit, symbol = (np.add.reduceat((kind == k).astype(np.int32), starts) for k in (1, 2, 3, 4))
    rows, seen = [], set()
    for x in lines:
        words = x.split()
        n = len(words)
        if n:
            distinct = len(set(words))
            again = sum(map(bytes.__eq__, words, words[1:]))
            known = sum(map(common.__contains__, x.lower().split()))
            rows.append((n, distinct / n, again / n, known / n, x.count(b"!!") / n, x[-1] in STOPS, x in seen))
            seen.add(x)
        else:
            rows.append((0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    n, distinct, again, known, shouts, stop, dup = np.array(rows, float).T
    signs = np.maximum(lower + upper + digit + symbol, 1)
    letters = np.maximum(lower + upper, 1)
    own = np.stack([np.ones(len(lines)), symbol / signs, upper / letters, digit / signs, shouts, distinct, again, np.log1p(n), signs / np.maximum(n, 1), stop, known, dup], 1)
    beside = own[:, BESIDE]
    before, after = np.vstack([beside[:1], beside[:-1]]), np.vstack([beside[1:], beside[-1:]])
    return np.hstack([own, before, after]), size


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray  # log potentials from label to label, bad first
    common: frozenset[bytes]

    def score(self, text: bytes) -> float:
        x, size = line_features(text, self.common)
        good = marginals(((x - self.mean) / self.scale) @ self.weights, self.moves)
        return float((good * size).sum() / size.sum())


def marginals(lean: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward; lean: log potential of good against bad."""
    n = len(lean)
    m = np.exp(moves - moves.max())
    (a, b), (c, d) = m.tolist()
    odds = np.exp(np.clip(lean, -40, 40)).tolist()
    ahead, back = [0.0] * n, [0.0] * n
    bad, good = 1.0, odds[0]
    ahead[0] = good / (bad + good)
    for k in range(1, n):
        p = ahead[k - 1]
        bad, good = (1 - p) * a + p * c, ((1 - p) * b + p * d) * odds[k]
        ahead[k] = good / (bad + good)
    p_bad = p_good = 0.5
    back[n - 1] = 0.5
    for k in range(n - 2, -1, -1):
        g = p_good * odds[k + 1]
        p_bad, p_good = a * p_bad + b * g, c * p_bad + d * g
        s = p_bad + p_good
        p_bad, p_good = p_bad / s, p_good / s
        back[k] = p_good
    f, r = np.array(ahead), np.array(back)
    up, down = f * r, (1 - f) * (1 - r)
    return up / np.maximum(up + down, 1e-300)


@dataclass(frozen=True)
class Chains:
    """Lines of all texts end to end, and where they lie in windows: x (lines x features), label of each line,
    row and column of each line in a windows x WINDOW grid, size of each window."""

    x: np.ndarray
    label: np.ndarray
    row: np.ndarray
    column: np.ndarray
    sizes: np.ndarray


def chains(examples: list[tuple[np.ndarray, int]], window: int = WINDOW) -> Chains:
    """Windows of the texts' lines, the longest first."""
    parts = [(x[k : k + window], y) for x, y in examples for k in range(0, len(x), window)]
    parts.sort(key=lambda p: -len(p[0]))
    sizes = np.array([len(x) for x, _ in parts])
    row = np.repeat(np.arange(len(parts)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Chains(np.concatenate([x for x, _ in parts]), np.repeat([y for _, y in parts], sizes), row, column, sizes)


def gradient(c: Chains, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels, and its gradient by weights and moves."""
    lean = np.clip(c.x @ weights.astype(c.x.dtype), -30, 30).astype(float)
    wide = int(c.sizes[0])
    odds = np.ones((len(c.sizes), wide))
    odds[c.row, c.column] = np.exp(lean)
    live = (np.arange(wide)[:, None] < c.sizes[None, :]).sum(1)  # windows that have a line there; the longest come first
    m = np.exp(moves)
    ahead = np.zeros((len(c.sizes), wide, 2))
    norm = np.ones((len(c.sizes), wide))
    ahead[:, 0, 0], ahead[:, 0, 1] = 1, odds[:, 0]
    for t in range(wide):
        k = live[t]
        if t:
            ahead[:k, t] = ahead[:k, t - 1] @ m
            ahead[:k, t, 1] *= odds[:k, t]
        norm[:k, t] = ahead[:k, t].sum(1)
        ahead[:k, t] /= norm[:k, t, None]
    back = np.full_like(ahead, 0.5)
    moved = np.zeros((2, 2))
    for t in range(wide - 2, -1, -1):
        k = live[t + 1]
        after = back[:k, t + 1].copy()
        after[:, 1] *= odds[:k, t + 1]
        both = ahead[:k, t, :, None] * m * after[:, None, :]
        moved += np.einsum("kij,k->ij", both, 1 / both.sum((1, 2)))
        b = after @ m.T
        back[:k, t] = b / b.sum(1, keepdims=True)
    p = (ahead * back)[c.row, c.column]
    good = p[:, 1] / p.sum(1)
    inner = c.column > 0
    seen = np.zeros((2, 2))
    for y in (0, 1):
        seen[y, y] = np.count_nonzero(inner & (c.label == y))
    by_weight = (c.label - good).astype(c.x.dtype) @ c.x
    likelihood = float(lean @ c.label + (seen * moves).sum() - np.log(norm).sum())
    return likelihood, np.concatenate([by_weight.astype(float), (seen - moved).ravel()])


def fit(examples: list[tuple[np.ndarray, int]], common: frozenset[bytes], steps: int = STEPS) -> Model:
    """Maximum likelihood with a small quadratic penalty, all windows of a step at once."""
    width = OWN + 2 * len(BESIDE)
    if not examples:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), common)
    c = chains(examples)
    mean, scale = c.x.mean(0, dtype=float), c.x.std(0, dtype=float) + 1e-3
    mean[0], scale[0] = 0, 1
    np.subtract(c.x, mean.astype(c.x.dtype), out=c.x)
    np.divide(c.x, scale.astype(c.x.dtype), out=c.x)
    at = np.zeros(width + 4)
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        _, g = gradient(c, at[:width], at[width:].reshape(2, 2))
        g = g / len(c.x) - DECAY * at
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g**2
        at = at + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, at[:width], at[width:].reshape(2, 2), common)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .filter("quality in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
    )
    # The sample's whole texts are written once; what follows reads them alone.
    rows = kept(texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality", F.xxhash64("doc_id").alias("turn"), F.xxhash64("text").alias("which")).dropDuplicates(["doc_id", "quality", "which"]), "labelled-texts")
    n_lines = (F.length("text") - F.length(F.expr("replace(cast(text as string), '\n', '')").cast("binary")) + 1).alias("n")
    taken, left = [], lines
    for r in rows.select("turn", "doc_id", "quality", "which", n_lines).orderBy("turn", "doc_id", "quality", "which").limit(sample).collect():
        if r.n <= left:
            taken.append((r.doc_id, r.quality, r.which))
            left -= r.n
    wanted = rows.sparkSession.createDataFrame(taken, "doc_id long, quality int, which long")
    rows = rows.join(F.broadcast(wanted), ["doc_id", "quality", "which"], "left_semi").select("doc_id", "text", "quality")

    def words(rows):
        found: dict[bytes, int] = {}
        for _, text, _ in rows:
            for w in text.lower().split():
                found[w] = found.get(w, 0) + 1
        yield from found.items()

    top = map_rows(rows, words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TOP_WORDS)
    common = frozenset(bytes(r.word) for r in top.collect())

    def features(rows):
        for _, text, quality in rows:
            x, _ = line_features(text, common)
            yield x.astype("<f4").tobytes(), quality

    width = OWN + 2 * len(BESIDE)
    found = map_rows(rows, features, "x binary, quality int").collect()  # SAMPLE_LINES lines at most
    found.sort(key=lambda r: (r.quality, bytes(r.x)))
    return fit([(np.frombuffer(r.x, "<f4").reshape(-1, width), r.quality) for r in found], common)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""

    def run(rows):
        for doc_id, text in rows:
            yield doc_id, model.score(text)

    out = map_rows(texts(docs), run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"))


def filtered(docs: DataFrame, model: Model, least: float = GOOD_FROM) -> DataFrame:
    """The rows of docs whose text scores at least that much, in one pass."""
    return keep_rows(docs, lambda text: model.score(text) >= least, ["text"])
