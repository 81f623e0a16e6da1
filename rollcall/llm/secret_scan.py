"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean query of trigrams is derived: literal runs that every match must hold, with
their alternatives. Postings (trigram, document) are made for the trigrams that any rule's query names; the
rules' queries are answered by joining postings with the (small, fixed) query table and counting, first
trigrams for an alternative, then groups for a rule. Only documents that satisfy a query are joined with
their texts and searched with that rule's regex. A rule without mandatory trigrams scans every text.

A document is known by its id and a hash of its text, so repeated rows get one answer each. Edge cases: null
texts are empty and have no spans; null ids are kept; an empty table gives no rows; other columns go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, unused

_parser = re._parser  # the standard library's own regex parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # what a scan finds, leftmost and without overlaps
    least: int = 0  # characters that `group` must have
    group: int = 0


# What each kind of secret looks like. Base kinds come first.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9a-zA-Z]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE
WIDE = 8  # a class or a repeat of so many forms at most is spelled out
FORMS = 64  # and so many strings at once

#: Groups, all of which a text must satisfy; a group is alternatives, each a set of trigrams that must be there.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What lower-case trigrams a text must hold to hold a match; empty: nothing is certain."""
    groups: list[set[str]] = []
    run = [""]

    def end_run() -> None:
        nonlocal run
        groups.append(set(run))
        run = [""]

    def forms(node) -> list[str] | None:
        """All strings that a node matches, if few; in lower case."""
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return [chr(arg).lower()]
        if name == "IN":
            out: set[str] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    out.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < WIDE:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return sorted(out) if len(out) <= WIDE else None
        if name == "SUBPATTERN":
            return joined(arg[3])
        if name == "BRANCH":
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else [s for p in parts for s in p]
        if name == "MAX_REPEAT" and arg[1] <= WIDE and (own := joined(arg[2])) is not None:
            out = ["".join(x) for n in range(arg[0], arg[1] + 1) for x in product(own, repeat=n)] if len(own) ** arg[1] <= FORMS else None
            return out
        return None

    def joined(nodes) -> list[str] | None:
        out = [""]
        for node in nodes:
            own = forms(node)
            if own is None or len(out) * len(own) > FORMS:
                return None
            out = [a + b for a in out for b in own]
        return out

    def walk(nodes) -> None:
        nonlocal run
        for node in nodes:
            own = forms(node)
            if own is not None and len(run) * len(own) <= FORMS:
                run = [a + b for a in run for b in own]
            elif str(node[0]) == "SUBPATTERN":
                walk(node[1][3])
            elif str(node[0]) == "MAX_REPEAT" and node[1][0] >= 1:
                end_run()
                walk(node[1][2])
                end_run()
            else:
                end_run()
        return

    walk(_parser.parse(pattern))
    end_run()
    query: Query = []
    for strings in groups:
        if min(map(len, strings)) < 3:
            continue
        sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
        query.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))
    return query


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, finish, label>> of a rule in a text, code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept_part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), kept_part, lambda x, p: F.struct(x.gap.alias("gap"), x.size.alias("size"), F.length(p).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,finish:int,label:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state.at + x.gap
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), (begin + x.size).alias("finish"), F.lit(rule.kind).alias("label"))
        out = F.when(x.part >= rule.least, F.concat(state.out, F.array(span))).otherwise(state.out)
        return F.struct((begin + x.size).alias("at"), out.alias("out"))

    return F.aggregate(F.filter(sizes, lambda x: x.size.isNotNull()), start, step, lambda s: s.out)


NONE = "array<struct<start:int,kind:int,finish:int,label:string>>"


def _found(text: Column, rule: Rule, number: int, wanted: Column | None = None) -> Column:
    hit = text.rlike(rule.pattern)
    return F.when(hit if wanted is None else wanted & hit, _spans(text, rule, number)).otherwise(F.array().cast(NONE))


def _known(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, text_hash, trigram) for the trigrams that any rule's query names."""
    trigrams = sorted({t for r in rules for g in trigram_query(r.pattern) for a in g for t in a})
    # explode() keeps the lower-case text from being made anew for each trigram.
    low = _known(docs).select("doc_id", "text_hash", F.explode(F.array(F.lower("text"))).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return low.select("doc_id", "text_hash", F.explode(there).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, text_hash, rules array<int>): documents whose postings satisfy a rule's query."""
    spark = docs.sparkSession
    rows, groups = [], []
    for number, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query:
            groups.append((number, len(query)))
        rows += [(number, g, a, t, len(alt)) for g, group in enumerate(query) for a, alt in enumerate(group) for t in alt]
    plan = spark.createDataFrame(rows, "rule int, part int, alt int, trigram string, need int")
    needed = spark.createDataFrame(groups, "rule int, parts int")
    met = (
        postings(docs, rules)
        .join(F.broadcast(plan), "trigram")
        .groupBy("doc_id", "text_hash", "rule", "part", "alt", "need")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter("n = need")
    )
    full = met.groupBy("doc_id", "text_hash", "rule").agg(F.count_distinct("part").alias("n")).join(F.broadcast(needed), "rule").filter("n = parts")
    return full.groupBy("doc_id", "text_hash").agg(F.collect_set("rule").alias("rules"))


def found(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, text_hash, spans) for every row, spans by start, then kind."""
    known = _known(docs)
    text = F.col("text")
    indexed = [(k, r) for k, r in enumerate(rules) if trigram_query(r.pattern)]
    scanned = [(k, r) for k, r in enumerate(rules) if not trigram_query(r.pattern)]
    every = known.select("doc_id", "text_hash", F.concat(F.array().cast(NONE), *[_found(text, r, k) for k, r in scanned]).alias("scanned"))
    wanted = candidates(docs, rules)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    checked = known.join(wanted.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), same)
    checked = checked.select("id", "hash", F.concat(F.array().cast(NONE), *[_found(text, r, k, F.array_contains("rules", k)) for k, r in indexed]).alias("indexed"))
    checked = checked.filter(F.size("indexed") > 0).groupBy("id", "hash").agg(F.first("indexed").alias("indexed"))
    out = every.join(checked, same, "left")
    spans = F.array_sort(F.concat("scanned", F.coalesce("indexed", F.array().cast(NONE))))
    return out.select("doc_id", "text_hash", spans.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.label, s.start.cast("string"), s.finish.cast("string"))), ",")


def reported(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per document the counts of base kinds, a digest of their spans and all spans as text."""
    spans = F.col("spans")
    of = lambda name: F.size(F.filter(spans, lambda s: s.label == name)).cast("long")
    base = F.filter(spans, lambda s: s.kind < len(BASE))
    return found(docs, rules).select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redacted(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mask; rows without spans, and null texts, stay as they are. Columns of
    any other name pass through."""
    key, digest, found_spans = unused(docs, "secret_id", "secret_hash", "secret_spans")
    hits = kept(found(docs, rules).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("spans").alias(found_spans)), "secret-spans")
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        cut = F.concat(state.out, F.substring(text, state.at + 1, s.start - state.at), F.lit(mask))
        after = F.greatest(state.at, s.finish)
        return F.struct(after.alias("at"), F.when(s.start >= state.at, cut).otherwise(state.out).alias("out"))

    clean = F.aggregate(found_spans, start, step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, F.length(text))))
    joined = docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(digest)), "left")
    return joined.withColumn("text", F.when(F.col(found_spans).isNotNull(), clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
