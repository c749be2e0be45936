"""Loading page files as they arrive, with the titles seen so far as keyed state.

A batch asks the state for its own titles only, so that its cost does not depend
on how much was loaded before. Titles and places go through the state; whole
pages are read from the batch's files once it is told which of them are new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dumpweave.plans.session import workers_find_library

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = ("file_start", "chunk", "pos")


class FirstOfTitle(StatefulProcessor):
    """Marks the first page of a title; the state of a title tells that it has one.

    Within a batch the earliest chunk comes first, and within a chunk the last
    position. Rows come one by one, and one at most waits for the next. They are
    plain rows: a frame for each title, most of which have one row, would cost
    far more than the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            for row in rows:
                yield Row(**row.asDict(), status="duplicate")
            return
        best = None
        for row in rows:
            if best is None:
                best = row
                continue
            if _place(row) < _place(best):
                row, best = best, row
            yield Row(**row.asDict(), status="duplicate")
        if best is not None:
            self.seen.update((True,))
            yield Row(**best.asDict(), status="added")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def _place(row: Row) -> tuple:
    back = None if row["pos"] is None else -row["pos"]
    # rows without a place come last
    return tuple((x is None, x or 0) for x in (row["file_start"], row["chunk"], back))


def keyed_load(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    key: str = "title",
    files_per_batch: int | None = None,
    existing: DataFrame | None = None,
) -> list[dict]:
    """Load all files of ``source`` that were not loaded yet, then stop; returns what each batch did.

    As ``incremental_load``: the first page of a title is added, any other is
    logged as a duplicate, in ``target`` by ``stream``, ``batch_id`` and
    ``status``, which ``load_log`` reads. Titles of ``existing`` are taken into
    the state when the stream begins; what other streams load is not known to
    this one. Pages have file_start, chunk and pos, which tell the pages of a
    file apart. NULL is a title like any other. A batch replayed after a
    failure starts from the state before it and overwrites its own folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    narrow = reader.parquet(source).select(key, *PLACE, F.col("_metadata.file_path").alias("file"))
    told = T.StructType([schema[key], *(schema[c] for c in PLACE)]).add("file", "string").add("status", "string")
    begin = None
    if existing is not None:
        begin = existing.select(F.col(key).cast(schema[key].dataType).alias(key)).distinct().groupBy(key)

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the batch does not tell which stream it belongs to")
        batch = batch.persist()
        try:
            files = [unquote(row["file"]) for row in batch.select("file").distinct().collect()]  # those of one batch
            pages = session.read.schema(schema).parquet(*files) if files else session.createDataFrame([], schema)
            pages = pages.select("*", F.col("_metadata.file_path").alias("file")) if files else pages.withColumn("file", F.lit(""))
            status = batch.select(*PLACE, "file", "status")
            (
                pages.join(status, [*PLACE, "file"])
                .select(*schema.names, "status")
                .write.mode("overwrite")
                .partitionBy("status")
                .parquet(f"{target}/stream={stream}/batch_id={batch_id}")
            )
        finally:
            batch.unpersist()

    workers_find_library(spark)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        marked = narrow.groupBy(key).transformWithState(FirstOfTitle(), told, "Append", "None", initialState=begin)
        query = (
            marked.writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return [_numbers(json.loads(progress.json)) for progress in query.recentProgress]


def _numbers(told: dict) -> dict:
    states = told.get("stateOperators") or [{}]
    return {
        "batch_id": told["batchId"], "input_rows": told["numInputRows"],
        "titles": states[0].get("numRowsTotal"), "new_titles": states[0].get("numRowsUpdated"),
    }
