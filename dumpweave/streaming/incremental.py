"""Loading page files as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpweave.operators.pages import dedupe_by_title


def _loaded(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame | None:
    full = T.StructType(schema.fields + [T.StructField("stream", T.StringType())])
    full = full.add("batch_id", "long").add("status", "string")
    try:
        return spark.read.schema(full).parquet(target)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def incremental_load(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    key: str = "title",
    files_per_batch: int | None = None,
    existing: DataFrame | None = None,
) -> None:
    """Load all files of ``source`` that were not loaded yet, then stop.

    A page whose title is not stored yet, in ``target`` or in ``existing`` (such
    as a table that was built before), is added, any other is logged as a
    duplicate. Both go to ``target`` in one write, by ``stream``, ``batch_id``
    and ``status``. ``stream`` is the id that the checkpoint gives: a new
    checkpoint starts a stream of its own beside what others have loaded. A
    batch replayed after a failure overwrites its own folder and is compared
    with all others but later ones of its stream, so it ends as if it ran once.
    Titles are unique over all history, so they are looked up in the stored
    table rather than kept as stream state; only its title column is read.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the batch does not tell which stream it belongs to")
        stored = _loaded(session, target, schema)
        if stored is not None:
            own = (F.col("stream") == stream) & (F.col("batch_id") >= batch_id)
            stored = stored.where(~own & (F.col("status") == "added")).select(key)
        if existing is not None:
            before = existing.select(key)
            stored = before if stored is None else stored.unionByName(before)
        (
            dedupe_by_title(batch, stored, key)
            .write.mode("overwrite")
            .partitionBy("status")
            .parquet(f"{target}/stream={stream}/batch_id={batch_id}")
        )

    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def load_log(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All pages that arrived, with ``stream``, ``batch_id`` and ``status``."""
    loaded = _loaded(spark, target, schema)
    if loaded is None:
        raise FileNotFoundError(target)
    return loaded
