"""What an executor and its Python workers hold at a time does not depend on how long the rows are."""

from dumpweave.llm import jaccard_join
from dumpweave.llm.frames import map_batches, small_table
from dumpweave.plans.session import BATCH_BYTES


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_rows_come_in_small_batches(spark):
    docs = spark.range(2_000, numPartitions=1).selectExpr("repeat(cast(id as string), 4000) as text")

    def size(batch):
        yield {"n": [batch.num_rows], "bytes": [batch.nbytes]}

    found = map_batches(docs, size, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 2_000
    # a batch ends with the row that reaches the limit
    assert max(r["bytes"] for r in found) < 2 * BATCH_BYTES


def test_small_tables_need_no_python(spark):
    rows = small_table(spark, {"a": [None, "x"], "b": [1, 2]}, "a string, b long")
    assert [tuple(r) for r in rows.collect()] == [(None, 1), ("x", 2)]
    assert "LocalRelation" in plan(rows)
    assert small_table(spark, {"a": []}, "a long").count() == 0


def test_wanted_texts_are_met_after_a_shuffle(spark, monkeypatch):
    seen = []

    def spy(df, **options):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, **options)

    store = jaccard_join.store
    monkeypatch.setattr(jaccard_join, "store", spy)
    texts = [" ".join(f"w{i}" for i in range(k, 60)) for k in (0, 1, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs, 4, 85, 100).collect()} == {0}
    # both Python steps of a plan would run at once if no shuffle lay between
    both = [p for p in seen if p.count("MapInArrow") == 2 and "doc_id" in p and "node" in p and "Join" in p]
    assert both
    assert all("BroadcastHashJoin" not in p for p in both)
