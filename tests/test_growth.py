"""Steps whose rows must grow with their input, and not with the product of what shares a key."""

import pytest
from pyspark.sql import functions as F

from rollcall.operators import intake as I


@pytest.fixture
def joined_rows(spark):
    """The most rows that any join of a DataFrame makes, once it is collected."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def most(plan) -> int:
        own = plan.metrics().get("numOutputRows") if "Join" in plan.nodeName() else None
        n = own.get().value() if own is not None and own.isDefined() else 0
        return max([n, *(most(plan.children().apply(k)) for k in range(plan.children().size()))])

    def run(df):
        rows = df.collect()
        return most(df._jdf.queryExecution().executedPlan()), rows

    yield run
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_matching_never_pairs_records_with_all_owners(spark, joined_rows):
    records = spark.range(300).select(F.col("id").alias("r"), F.lit("k").alias("i")).union(spark.sql("SELECT 0L, 'one' UNION ALL SELECT 900L, 'one' UNION ALL SELECT 901L, NULL"))
    owners = spark.range(300).select(F.lit("k").alias("i"), F.col("id").alias("o")).union(spark.sql("SELECT 'one', 7L UNION ALL SELECT 'one', 7L"))
    n, rows = joined_rows(I.matched(records, owners, "r", ["i"], "o"))
    got = {r.r: (r.o, r.state) for r in rows}
    assert n <= 400 and len(got) == len(rows) == 302
    assert got[0] == got[5] == (None, "held") and got[900] == (7, "linked") and got[901] == (None, "new")


def test_complaints_never_meet_all_people_of_a_contact(spark, joined_rows):
    contacts = spark.range(300).select(F.lit("c").alias("contact"), F.col("id").alias("p")).union(spark.sql("SELECT 'one', 7L UNION ALL SELECT 'one', 7L UNION ALL SELECT 'two', 7L"))
    complaints = spark.range(300).select(F.col("id").alias("k"), F.lit("c").alias("contact")).union(
        spark.sql("SELECT * FROM VALUES (900L, 'one'), (901L, 'none'), (902L, NULL), (903L, 'one'), (903L, 'two'), (904L, 'one'), (904L, 'c'), (905L, 'c'), (905L, 'one')")
    )
    n, rows = joined_rows(I.complaint_matches(complaints, contacts, "k", "contact", "p"))
    got = {r.k: (r.people, r.state, r.p) for r in rows}
    assert n <= 700 and len(got) == len(rows) == 306
    assert got[5] == got[904] == got[905] == (300, "needs_review", None) and got[900] == got[903] == (1, "suppressed", 7)
    assert got[901] == got[902] == (0, "needs_review", None)


def test_files_with_headers_hold_many_records(spark):
    from rollcall.queries import sources as Q
    from rollcall.sources.delimited import read_delimited

    lines = spark.range(500).select(F.concat(F.col("id").cast("string"), F.lit(',"two\nlines"')).alias("value"))
    path = Q._headed(lines, "id,name\r\n", "csv")
    files = spark.read.format("binaryFile").load(path)
    assert files.count() == 2 and files.filter("startswith(cast(content AS string), 'id,name\r\n')").count() == 2
    back = read_delimited(spark, path, "id long, name string")
    assert sorted(r.id for r in back.collect()) == list(range(500)) and back.filter("name != 'two\\nlines'").isEmpty()


def test_verified_chains_are_hashed_once(spark):
    from rollcall.queries import QUERIES

    plan = QUERIES["e28_verified_chains"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") <= 2  # only the events written anew, for each of two uses


def test_a_run_reads_and_writes_each_entry_of_its_state_once():
    import pandas as pd

    from rollcall.streaming.guards import Policy, _Processor

    class Kept(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def containsKey(self, k):
            Kept.calls += 1
            return k in self

        def getValue(self, k):
            return self.get(k)

        def updateValue(self, k, v):
            Kept.calls += 1
            self[k] = v

    def verdicts(sizes):
        own, kept, out = _Processor(Policy(pages_per_run=40)), Kept(), []
        own.kept = kept
        pages = pd.DataFrame([{"run": 1, "ord": k, "seen": pd.Timestamp(k), "url": f"u{k % 50}", "domain": "d", "depth": 0, "excluded": False, "token": None, "ok": k % 4 > 0, "content": f"c{k}", "records": [f"r{k}"]} for k in range(100)])
        for a, b in zip(sizes, sizes[1:]):
            out += [v for frame in own.handleInputRows((1,), iter([pages[a:b]]), None) for v in frame["verdict"]]
        return out, len(kept)

    whole, entries = verdicts([0, 100])
    assert Kept.calls == entries  # nothing is read for a run's first pages, each entry is written once
    assert verdicts([0, 30, 31, 100])[0] == verdicts(range(101))[0] == whole


def test_new_edges_keep_no_pairs_of_origins_and_nodes(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from rollcall.operators import graph as G

    monkeypatch.setattr(G, "folder", lambda *_: f"file://{tmp_path}/g")
    dates = "date'2020-01-01' AS effective_from, date'2020-01-01' AS effective_to"
    knot = spark.sql(f"SELECT a.id AS child, b.id AS parent, {dates} FROM range(20) a JOIN range(20) b ON a.id <> b.id")
    later = spark.sql("SELECT id % 20 AS child, id AS parent, date'2021-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to FROM range(100, 250)")
    new = spark.sql(f"SELECT id AS child, id % 20 AS parent, {dates} FROM range(100, 250) UNION ALL SELECT 3, 4, {dates}")
    assert [r.node for r in G.cycles(knot.union(later), new).collect()] == [3]
    tables = {}
    for p in glob.glob(f"{tmp_path}/g/**/*.parquet", recursive=True):
        folder = p.rsplit("/", 1)[0]
        tables[folder] = tables.get(folder, 0) + pq.read_metadata(p).num_rows
    assert max(tables.values()) <= 2 * (380 + 150 + 151)


def test_entities_are_decoded_once_for_all_uses(spark):
    from rollcall.functions import emails as E

    for c in (E.addresses(F.col("c")), E.of_mailto(F.col("c"))):
        plan = spark.createDataFrame([("a",)], "c string").select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("utf-32") == 1


@pytest.mark.parametrize("name", ["x31_x35_decoded", "x13_x17_rules_by_scope", "h5_single_profiles"])
def test_small_files_are_worked_on_by_many_tasks(spark, name):
    from rollcall.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_organizations_are_folded_from_one_narrow_table(spark):
    from rollcall.operators.identity import folded

    own = spark.range(20).selectExpr("id AS record", "id AS observed", "1 AS tier", "'f' AS fingerprint", "'n' AS name", "0.5D AS confidence", "'m' AS method", "'w' AS website", "rand() AS evidence")
    own = own.withColumn("organization", F.when(F.col("evidence") < 2, F.col("record") % 3))
    out = folded(own, ["method"], ["website"])
    assert "rand(" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 3


def test_orders_of_one_nation_meet_its_suppliers_together(spark, tmp_path):
    from rollcall.queries import QUERIES

    orders = spark.range(2000).selectExpr("if(id = 7, NULL, id) AS o_orderkey", "if(id = 8, NULL, if(id % 3 = 0, 'F', 'P')) AS o_orderstatus").coalesce(1)
    supplier = spark.range(250).selectExpr("id AS s_suppkey", "if(id = 9, NULL, id % 25) AS s_nationkey").coalesce(1)
    orders.write.parquet(str(tmp_path / "orders.parquet")), supplier.write.parquet(str(tmp_path / "supplier.parquet"))
    rows = QUERIES["j15_array_containment"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    want = [(o, s) for o in range(2000) if o not in (7, 8) and o % 3 for s in range(250) if s != 9 and s % 25 in {o % 25, (o + 7) % 25}]
    assert sorted((r.o_orderkey, r.s_suppkey) for r in rows) == want
    nations = {}
    for r in rows:
        nations.setdefault(r.task, set()).add(r.s_suppkey % 25)
    assert len(nations) == 4 and max(map(len, nations.values())) <= 10


def test_orders_of_every_status_meet_suppliers(spark, tmp_path):
    from rollcall.queries import QUERIES

    spark.sql("SELECT * FROM VALUES (1L, 'P'), (2L, 'F'), (3L, 'O'), (4L, NULL), (NULL, 'P'), (-3L, 'F') AS t(o_orderkey, o_orderstatus)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT id AS s_suppkey, CAST(id AS INT) AS s_nationkey FROM range(25) UNION ALL SELECT NULL, 9 UNION ALL SELECT 30L, NULL UNION ALL SELECT 2L, 2").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = QUERIES["j15_array_containment"](spark, str(tmp_path)).collect()
    want = [(1, 1), (1, 8), (2, 2), (2, 2), (2, 9), (2, None), (3, 3), (3, 10), (4, 4), (4, 11), (-3, 4)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_files_of_orders_and_suppliers_pack(spark, tmp_path):
    import glob
    import os

    from rollcall.queries import QUERIES

    spark.sql("SELECT id AS o_orderkey, 'P' AS o_orderstatus FROM range(2500)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT nullif(id, 77) AS s_suppkey, CAST(id % 25 AS INT) AS s_nationkey FROM range(25000)").write.parquet(str(tmp_path / "supplier.parquet"))
    QUERIES["j15_array_containment"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    total = "SELECT count(*), count(s_suppkey), sum(CAST(xxhash64(o_orderkey, s_suppkey) AS DECIMAL(20, 0))) FROM {t}"
    want = spark.sql("SELECT o_orderkey, s_suppkey FROM {o} JOIN {s} ON s_nationkey IN (o_orderkey % 25, (o_orderkey + 7) % 25)", o=spark.read.parquet(str(tmp_path / "orders.parquet")), s=spark.read.parquet(str(tmp_path / "supplier.parquet")))
    assert spark.sql(total, t=spark.read.parquet(str(tmp_path / "out"))).first() == spark.sql(total, t=want).first()
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet"))) < 0.5 * 2500 * 2 * 1000
