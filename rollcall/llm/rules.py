"""Quality rules: base counts of each text, and its divergence from references of its language.

References are learned from the whole corpus: for each language the share of characters in each class, and
the shares of its COMMON most frequent words (the rest together). A text's own histograms are compared with
them by the Jensen-Shannon distance (base 2, so 0 to 1). A text is dropped if its character classes lie
further than CHAR_LIMIT, or its words further than WORD_LIMIT, from the reference of its language; each test
has a least length, below which the histogram says too little.

Edge cases: a null text counts as empty; a null and an empty language are one; repeated rows are judged
each for itself; an empty table gives no rows. Texts that fail the base rules are never kept.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, kept, map_rows, unused

# The symbols that the base rules count, and the classes of bytes.
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other punctuation", "beyond ASCII")
COMMON = 60
CHAR_LIMIT, CHAR_LEAST = 0.33, 200
WORD_LIMIT, WORD_LEAST = 0.385, 100
FLUSH = 200_000  # distinct words that a task counts before it passes them on
LANGUAGES = 512  # so many languages' references lie in memory; those of the others are joined to their documents
SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def _classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, *range(9, 14)), b".,;:'!?\"-()", SYMBOLS, (), range(128, 256))):
        out[[*chars]] = k
    return out


CLASS_OF = _classes()
#: Character shares, common words, and their shares and the rest's.
Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def char_counts(text: bytes) -> np.ndarray:
    """Characters by class, without white space; continuation bytes do not count."""
    raw = np.frombuffer(text, np.uint8)
    n = np.bincount(CLASS_OF[raw], minlength=len(CLASSES)).astype(float)
    n[7] -= np.count_nonzero((raw & 0xC0) == 0x80)
    n[3] = 0
    return n


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    size = len(seen)
    # Two steps, so that keys never leave 64 bits: pairs are numbered before the third word joins.
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, which, n = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    twice = n[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(np.count_nonzero(inside))


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _languages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))


def _reference(chars: list[tuple[int, int]], words: list[tuple[int, bytes, int]], total: int) -> Reference:
    """Character shares, common words, their shares and the rest's, from counts by class, the most frequent words and all words' number."""
    n = np.zeros(len(CLASSES))
    for k, count in chars:
        n[k] = count
    words = sorted(words)
    p = np.array([x[2] for x in words] + [total - sum(x[2] for x in words)], float)
    return n / max(n.sum(), 1), {bytes(w): k for k, (_, w, _) in enumerate(words)}, p / max(p.sum(), 1)


def references(docs: DataFrame, common: int = COMMON) -> tuple[dict[str, Reference], DataFrame | None]:
    """lang -> reference for the LANGUAGES largest languages, and a table of the others' (None if there are none):
    lang, chars, words and total, as _reference() takes them. Every language has its own reference."""

    def count(rows):
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        held = 0

        def flush():
            yield from ((lang, 0, w, n) for lang, own in words.items() for w, n in own.items())
            yield from ((lang, 1, b"%d" % k, int(n)) for lang, own in chars.items() for k, n in enumerate(own))
            words.clear()
            chars.clear()

        for _, text, lang in rows:
            own = words.setdefault(lang, Counter())
            held -= len(own)
            own.update(text.lower().split())
            held += len(own)
            n = char_counts(text)
            held += 0 if lang in chars else len(CLASSES)
            chars[lang] = chars[lang] + n if lang in chars else n
            if held > FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    counts = map_rows(_languages(docs), count, "lang string, kind int, item binary, n long")
    counts = kept(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "word-counts")
    total = F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("total")
    sizes = counts.groupBy("lang").agg(total, F.sum("n").alias("size"))
    top = counts.filter("kind = 0").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))).filter(F.col("k") <= common)
    words = top.groupBy("lang").agg(F.collect_list(F.struct("k", "item", "n")).alias("words"))
    chars = counts.filter("kind = 1").groupBy("lang").agg(F.collect_list(F.struct(F.col("item").cast("string").cast("int").alias("k"), "n")).alias("chars"))
    table = kept(sizes.join(chars, "lang", "left").join(words, "lang", "left"), "references")
    first = table.orderBy(F.desc("size"), "lang").limit(LANGUAGES + 1).collect()
    refs = {r.lang: _reference(r.chars or [], r.words or [], r.total) for r in first[:LANGUAGES]}
    rest = table.filter(~F.col("lang").isin(list(refs))).drop("size") if len(first) > LANGUAGES else None
    return refs, rest


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(), np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def verdict(text: bytes, lang: str | bytes, refs: dict, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> tuple:
    """The base counts, base_failed, kept and both distances of a text."""
    lang = lang.decode() if isinstance(lang, bytes) else lang
    words = text.split()
    n = len(words)
    spaces = sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)) - spaces
    symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    char_shares, common, word_shares = refs.get(lang, BLANK)
    far_chars = far_words = None
    if chars >= CHAR_LEAST and char_shares.any():
        own = char_counts(text)
        far_chars = distance(own / max(own.sum(), 1), char_shares)
    if n >= WORD_LEAST and common:
        own = np.zeros(len(word_shares))
        for w in text.lower().split():
            own[common.get(w, -1)] += 1
        far_words = distance(own / n, word_shares)
    keep = not failed and (far_chars is None or far_chars <= char_limit) and (far_words is None or far_words <= word_limit)
    return n, chars, symbols, dup_lines(text), repeats, failed, keep, far_chars, far_words


BLANK = (np.zeros(len(CLASSES)), {}, np.ones(1))


def _parts(docs: DataFrame, lang: Column, found: tuple[dict, DataFrame | None]) -> list[tuple[DataFrame, str | None]]:
    """docs in up to two parts: those whose reference lies in memory, and those with a further column, named, that holds
    theirs."""
    refs, rest = found
    if rest is None:
        return [(docs, None)]
    there = lang.isin(list(refs))
    key, ref = unused(docs, "reference_lang", "reference")
    rest = rest.select(F.col("lang").alias(key), F.struct("chars", "words", "total").alias(ref))
    return [(docs.filter(there), None), (docs.filter(~there).join(rest, lang == F.col(key)).drop(key), ref)]


def _joined(memo: dict, lang: str | bytes, ref: dict) -> dict:
    """A joined reference as verdict() takes it; few are held at a time."""
    lang = lang.decode() if isinstance(lang, bytes) else lang
    if lang not in memo:
        if len(memo) >= LANGUAGES:
            memo.clear()
        chars, words = ([tuple(x.values()) for x in ref[k] or []] for k in ("chars", "words"))
        memo[lang] = _reference(chars, words, ref["total"])
    return memo


def judged(docs: DataFrame, refs: tuple | None = None, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Per document the base counts, base_failed, kept and both distances (null below the least length)."""
    found = references(docs) if refs is None else refs
    held = found[0]

    def run(rows):
        memo: dict[str, Reference] = {}
        for doc_id, text, lang, *ref in rows:
            yield doc_id, *verdict(text, lang, _joined(memo, lang, ref[0]) if ref else held, char_limit, word_limit)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return reduce(DataFrame.union, (map_rows(part, run, schema) for part, _ in _parts(_languages(docs), F.col("lang"), found)))


def filtered(docs: DataFrame, refs: tuple | None = None) -> DataFrame:
    """The rows of docs that judged() keeps, in one pass."""
    found = references(docs) if refs is None else refs
    held = found[0]
    memo: dict[str, Reference] = {}
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    out = []
    for part, ref in _parts(docs, lang, found):
        if ref:
            out.append(keep_rows(part, lambda text, lang, ref: verdict(text, lang, _joined(memo, lang, ref))[-3], ["text", "lang"], [ref]).drop(ref))
        else:
            out.append(keep_rows(part, lambda text, lang: verdict(text, lang, held)[-3], ["text", "lang"]))
    return reduce(DataFrame.union, out)
