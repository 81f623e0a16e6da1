"""Packs of rules: merged on the driver, chosen by scope, named by a hash of what they say."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_packs(packs: Iterable[dict]) -> dict[str, object]:
    """code -> entry over packs (name, entries: list of (code, entry), overrides: codes). A later pack replaces only codes
    that it declares in overrides; any other code that is there already, or twice in one pack, is an error."""
    out: dict[str, object] = {}
    for pack in packs:
        codes = [c for c, _ in pack["entries"]]
        if twice := {c for c in codes if codes.count(c) > 1}:
            raise ValueError(f"{pack['name']} states {sorted(twice)} twice")
        if taken := {c for c in codes if c in out and c not in pack.get("overrides", ())}:
            raise ValueError(f"{pack['name']} replaces {sorted(taken)} without saying so")
        out |= dict(pack["entries"])
    return out


def version(rules: object) -> str:
    """16 digits that change whenever the rules do."""
    return hashlib.sha256(json.dumps(rules, sort_keys=True, default=str).encode()).hexdigest()[:16]


def for_scope(packs: list[dict], sector: str | None, level: str | None) -> list:
    """The rules of packs (sectors, levels, rules) whose scope has both, in order; empty scopes hold all."""
    fits = lambda p: (not p["sectors"] or sector in p["sectors"]) and (not p["levels"] or level in p["levels"])
    return [r for p in packs if fits(p) for r in p["rules"]]


def by_scope(sector: Column, level: Column, packs: list[dict], scopes: list[tuple[str, str]], use) -> Column:
    """use(rules) with the rules of each row's scope, one branch for each of the scopes; others get the unscoped rules."""
    out = None
    for s, v in scopes:
        met = (sector == s) & (level == v)
        out = F.when(met, use(for_scope(packs, s, v))) if out is None else out.when(met, use(for_scope(packs, s, v)))
    rest = use(for_scope(packs, None, None))
    return rest if out is None else out.otherwise(rest)
