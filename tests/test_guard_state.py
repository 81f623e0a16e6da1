"""Guards over a stream: a run that goes idle starts anew."""

from datetime import datetime, timedelta

import pytest

from rollcall.shipping import ship
from rollcall.streaming.guards import PAGES, Guard, Policy, guarded


def page(run, n, minutes, url):
    return (run, n, datetime(2024, 1, 1) + timedelta(minutes=minutes), url, "d", 1, False, None, True, f"c{n}", [f"r{n}"])


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_idle_runs_expire(spark, tmp_path, rocks):
    ship(spark)
    policy = Policy(idle_ms=3_600_000)
    for rows in ([page(1, 0, 0, "a"), page(1, 1, 1, "a"), page(2, 0, 0, "x")], [page(2, 1, 300, "y")], [page(1, 2, 301, "a"), page(2, 2, 302, "x"), page(2, 3, 303, "y")]):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        guarded(spark.readStream.schema(PAGES).parquet(f"{tmp_path}/in"), policy, f"{tmp_path}/out", f"{tmp_path}/state", "1 minute").awaitTermination()
    got = {(r.run, r.ord): r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1, 1] == "visited" and got[1, 2] == "continue" and got[1, -1] == "expired" and got[2, 3] == "visited"


def test_order_of_guards():
    state = {}
    guard = Guard(Policy(pages_per_run=2, deepest=3), lambda *k: state.get(k, 0), lambda a, b, n: state.__setitem__((a, b), n))

    class Page:
        url, domain, depth, excluded, token, ok, content, records = "u", "d", 0, False, "t", True, "c", []

    def seen(**own):
        p = Page()
        p.__dict__.update(own)
        return guard.verdict(p)

    assert seen() == "empty_success" and seen() == "visited" and seen(url="v", depth=4) == "too_deep"
    assert seen(url="v") == "pagination_loop" and seen(url="v", token=None, ok=False) == "failed" and seen(url="v", token="w") == "duplicate_content"
    assert seen(url="z", token=None) == "page_budget_exhausted"
