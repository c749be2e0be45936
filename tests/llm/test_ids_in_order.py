"""Token files are written from ids that are stored in order: no shuffle lies beside them and the files."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dumpweave.llm import token_files
from dumpweave.llm.queries import tokenizer_file

BPE = tokenizer_file("byte_bpe_50k.json")


def test_ids_are_not_shuffled(spark, odd, monkeypatch):
    plans = []

    def spy(df, function, ddl):
        if "ids" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return map_partition(df, function, ddl)

    map_partition = token_files.map_partition
    monkeypatch.setattr(token_files, "map_partition", spy)
    found = token_files.token_files(odd, BPE).collect()
    assert len(found) == odd.count()
    # ids are counted, and written
    assert len(plans) == 2 and not any("Exchange" in plan for plan in plans)


@pytest.mark.parametrize("split", ["1k", "64k", "128m"])
def test_rows_keep_their_order_however_a_table_is_split(spark, tmp_path, split):
    # four sorted partitions of several row groups each
    kind, texts = "<u2", {i: np.arange(i % 700, i % 700 + i % 50 + 1, dtype="<u2") for i in range(4000)}
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.monotonically_increasing_id().alias("place"))
    own = spark.createDataFrame([(i, x.tobytes()) for i, x in texts.items()], "doc_id long, ids binary")
    rows = rows.join(F.broadcast(own), "doc_id")
    path = str(tmp_path / "encoded")
    rows.write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        encoded = spark.read.schema(rows.schema).parquet(path)
        code = token_files.Code(token_files.code_lengths(token_files.id_counts(encoded, kind, 1000)))
        catalogue = token_files.write_files(encoded, code, f"file://{tmp_path}/ids", kind)
        found = token_files.read_files(catalogue, code).orderBy("start").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["doc_id"] for r in found] == list(range(4000))
    at = 0
    for r in found:
        ids = texts[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)


def test_rows_that_share_an_id_are_dealt_out(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        encoded = token_files.encoded_texts(docs, BPE, 2, "<u2")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert encoded.select(F.shiftright("place", 33)).distinct().count() > 1
