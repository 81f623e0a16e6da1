"""Python workers outlive stages: what one operator keeps there doesn't stay beside the next one's."""

from rollcall.llm import bpe
from rollcall.llm.common import keep_rows, map_columns, map_rows
from rollcall.llm.queries import vocabulary


def test_workers_let_go_of_other_operators_tables(spark):
    docs = spark.range(64).repartition(8).selectExpr("id AS doc_id", "concat('some words ', id) AS text")

    def held(rows):
        for doc_id, _ in rows:
            yield doc_id, bpe.loaded.cache_info().currsize

    def held_columns(rows):
        for doc_id, _ in rows:
            yield [doc_id], [bpe.loaded.cache_info().currsize]

    after = {
        "rows": lambda: {r.n for r in map_rows(docs, held, "doc_id long, n long").collect()},
        "columns": lambda: {r.n for r in map_columns(docs, held_columns, "doc_id long, n long").collect()},
        "filter": lambda: {64 - keep_rows(docs, lambda text: bpe.loaded.cache_info().currsize == 0, ["text"]).count()},
    }
    for name, run in after.items():
        assert bpe.encode_digests(docs, vocabulary()).count() == 64
        assert run() == {0}, name
