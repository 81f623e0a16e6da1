"""Components against union-find, organisations against an ordered fold, with evidence that a third of all rows share."""

import random

import pytest

from rollcall.operators.components import components
from rollcall.operators.identity import TIERS, conflicting, folded, resolved
from rollcall.operators.ranks import running_max
from pyspark.sql import functions as F


def united(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for node, key in links:
        if node is None or key is None:
            continue
        find(node)
        a, b = sorted((find(node), find(first.setdefault(key, node))))
        parent[b] = a
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "hot"])
def test_components(spark, kind):
    rng = random.Random(2)
    if kind == "random":
        links = [(rng.randrange(300), f"k{rng.randrange(260)}") for _ in range(450)]
    elif kind == "path":
        names = rng.sample(range(200), 200)
        links = [(n, f"k{k}") for k, n in enumerate(names)] + [(n, f"k{k + 1}") for k, n in enumerate(names)]
    elif kind == "star":
        links = [(k, f"k{k}") for k in range(150)] + [(1000, f"k{k}") for k in range(150)]
    else:
        links = [(k, "everywhere") for k in range(0, 3000, 3)] + [(k, f"own{k}") for k in range(3000)] + [(1, "own5"), (None, "everywhere"), (7, None)]
    got = components(spark.createDataFrame(links, "node long, key string"))
    assert {r.node: r.component for r in got.collect()} == united(links)


COLUMNS = "record long, observed int, identifier_system string, identifier_state string, identifier_value string, source_system string, source_value string, parent string, jurisdiction string, domain string, type string, name_key string, document string, name string, site string, confidence double"


def arrivals(n, hot):
    rng = random.Random(n)
    out = []
    for k in range(n):
        body = 0 if hot and k % 3 == 0 else rng.randrange(n // 6)
        some = lambda share, x: x if rng.random() < share else None  # noqa: E731, B023
        number = some(0.4, f"N{body}") if not (hot and body == 0) else "N0"
        source = some(0.4, f"Src {body}")
        out.append((k, rng.randrange(50), number and "tax", number and some(0.0, "X"), number, source and "erp", source, some(0.4, f"p{body % 4}"), some(0.7, "j"), some(0.5, f"d{body}"), "t", f"n{body}", f"doc{rng.randrange(5)}", f"name {k}", some(0.5, f"site {k}"), rng.random()))
    return out


def fold(rows):
    """Plain: {organization: row} of the arrivals, each with the tiers of its evidence."""
    links, best = [], {}
    for r in rows:
        _, _, system, state, number, source, value, parent, where, domain, kind, key, doc = r[:13]
        own = []
        if number is not None:
            own.append((4, f"oid:{system}:" + (f"{state}:" if state else "") + number))
        if value is not None:
            own.append((3, f"sid:{source}:{value}"))
        if parent is not None:
            own.append((2, f"psn:{where or '-'}:{parent}:{kind}:{key}"))
        elif domain is not None and where is not None:
            own.append((1, f"dsn:{where}:{domain}:{kind}:{key}"))
        else:
            own.append((0, f"amb:{doc}:{kind}:{key}"))
        best[r[0]] = own[0]
        links += [(r[0], " ".join(fp.lower().split())) for _, fp in own]
    of, out = united(links), {}
    for r in sorted(rows):
        tier, fp = best[r[0]]
        new = {"name": r[13], "type": r[10], "site": r[14], "confidence": r[15], "first_seen": r[1], "last_seen": r[1], "tier": tier, "fp": fp}
        o = out.setdefault(of[r[0]], new)
        if o is new:
            continue
        if tier >= o["tier"]:
            o |= {"type": r[10], "site": r[14] or o["site"], "confidence": max(o["confidence"], r[15])}
            if r[1] >= o["last_seen"]:
                o["name"] = r[13]
        if tier > o["tier"]:
            o |= {"tier": tier, "fp": fp}
        o["last_seen"] = max(o["last_seen"], r[1])
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_organizations(spark, hot):
    rows = arrivals(900, hot)
    own = resolved(spark.createDataFrame(rows, COLUMNS).repartition(6))
    got = {r.organization: r for r in folded(own, ["type"], ["site"]).collect()}
    want = fold(rows)
    assert got.keys() == want.keys()
    for k, o in want.items():
        r = got[k]
        assert (r["name"], r.type, r.site, r.confidence, r.first_seen, r.last_seen, r.identity_tier, r.identity_fingerprint, r.needs_review) == (o["name"], o["type"], o["site"], o["confidence"], o["first_seen"], o["last_seen"], TIERS[o["tier"]], o["fp"], o["tier"] == 0)


def test_conflicts(spark):
    base = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], [0, 1, "tax", None, "A", "erp", "1", None, None, None, "t", "n", "d", "x", None, 0.5], strict=True))
    rows = [base, base | {"record": 1, "identifier_value": "B"}, base | {"record": 2, "source_value": "2", "document": "e", "identifier_value": "C"}]
    got = conflicting(resolved(spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS))).collect()
    assert [tuple(r) for r in got] == [(0, "tax", None, 2)]


def test_running_max(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 3 else f"g{k % 4}", k, rng.choice([None, rng.randrange(1000)])) for k in range(900)]
    got = {r.k: r.high for r in running_max(spark.createDataFrame(rows, "g string, k long, v long"), "v", [F.col("k")], "high", ["g"]).collect()}
    high = {}
    for g, k, v in rows:
        assert got[k] == high.get(g)
        if v is not None:
            high[g] = max(v, high.get(g, -1))
