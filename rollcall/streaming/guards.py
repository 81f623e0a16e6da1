"""Guards of a crawl as keyed stream state: what stops a page, decided from all pages of its run that came before.

State of a run lies in maps and counters of the state store, an entry for each URL, body, record, token and domain: a
page reads and writes the entries that it names, and nothing grows with the run but the store on disk. A run's pages are
decided in their order, one after the other, since every decision changes the next; runs are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PAGES = "run long, ord long, seen timestamp, url string, domain string, depth int, excluded boolean, token string, ok boolean, content string, records array<string>"
VERDICTS = "run long, ord long, verdict string"


@dataclass(frozen=True)
class Policy:
    pages_per_run: int = 1000
    pages_per_domain: int = 200
    deepest: int = 5
    failures_per_domain: int = 5
    pages_without_new: int = 3
    idle_ms: int = 0  # event time after which a run's state goes, once no page has come; 0: never


class Guard:
    """The verdict on each page of one run; kept is its state: count(name, key) and put(name, key, n)."""

    def __init__(self, policy: Policy, count, put):
        self.policy, self.count, self.put = policy, count, put

    def _claimed(self, kind: str, key: str | None) -> bool:
        """Whether it was there before; now it is."""
        if key is None:
            return False
        before = self.count(kind, key)
        if not before:
            self.put(kind, key, 1)
        return bool(before)

    def _add(self, kind: str, key: str) -> int:
        n = self.count(kind, key) + 1
        self.put(kind, key, n)
        return n

    def verdict(self, page) -> str:
        p, count = self.policy, self.count
        if count("run", "pages") >= p.pages_per_run:
            return "page_budget_exhausted"
        if page.depth > p.deepest:
            return "too_deep"
        if count("url", page.url):
            return "visited"
        if count("domain", page.domain) >= p.pages_per_domain:
            return "domain_budget_exhausted"
        if count("failures", page.domain) >= p.failures_per_domain:
            return "repeated_failures"
        if page.excluded:
            return "excluded"
        if self._claimed("token", page.token):
            return "pagination_loop"
        if not page.ok:
            self._add("failures", page.domain)
            return "failed"
        self.put("url", page.url, 1)
        self._add("run", "pages")
        self._add("domain", page.domain)
        if count("failures", page.domain):
            self.put("failures", page.domain, 0)
        if self._claimed("content", page.content):
            return "duplicate_content"
        records = list(page.records) if page.records is not None else []
        new = sum(not self._claimed("record", r) for r in records)
        if not records and page.depth == 0:
            return "empty_success"
        if new:
            self.put("run", "dry", 0)
        elif self._add("run", "dry") >= p.pages_without_new:
            return "no_progress"
        return "continue"


class _Processor(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "kind string, name string", "n long")
        self.due = handle.getValueState("due", "at long")

    def _count(self, kind: str, name: str) -> int:
        own = self.kept.getValue((kind, name)) if self.kept.containsKey((kind, name)) else None
        return int(own[0]) if own is not None else 0

    def _put(self, kind: str, name: str, n: int) -> None:
        self.kept.updateValue((kind, name), (n,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(rows).sort_values("ord")
        # Each entry that these pages name is read once and written once; a run's first pages find none.
        held, changed, new = {}, set(), not self.kept.exists()

        def count(kind: str, name: str) -> int:
            if (kind, name) not in held:
                held[kind, name] = 0 if new else self._count(kind, name)
            return held[kind, name]

        def put(kind: str, name: str, n: int) -> None:
            held[kind, name] = n
            changed.add((kind, name))

        guard = Guard(self.policy, count, put)
        verdicts = [guard.verdict(p) for p in own.itertuples(index=False)]
        for entry in changed:
            self._put(*entry, held[entry])
        yield pd.DataFrame({"run": key[0], "ord": own["ord"], "verdict": verdicts})
        if self.policy.idle_ms:
            at = int(own["seen"].max().timestamp() * 1000) + self.policy.idle_ms
            if self.due.exists():
                self.handle.deleteTimer(int(self.due.get()[0]))
            self.due.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.due.clear()
        yield pd.DataFrame({"run": [key[0]], "ord": [-1], "verdict": ["expired"]})

    def close(self) -> None:
        pass


def guarded(pages: DataFrame, policy: Policy, target: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Verdicts on a stream of pages (as in PAGES), all there are now, appended to target once over restarts. Of each
    trigger a run's pages are taken in the order of ord; pages of earlier triggers count as before. Needs the RocksDB
    state store: spark.sql.streaming.stateStore.providerClass."""
    own = pages.withWatermark("seen", late).groupBy("run")
    mode = "EventTime" if policy.idle_ms else "None"
    out = own.transformWithStateInPandas(_Processor(policy), VERDICTS, "Append", mode)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
