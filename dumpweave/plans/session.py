"""Where lineage may be cut, and the runtime settings the plans count on."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that all executors share.

    It is the one the session names in ``spark.checkpoint.dir``; where that is
    unset, a folder in the warehouse. Never a machine's temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_scopes: list[str] = []


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """Delete the intermediate tables made inside, once what reads them is done.

    Write or collect the result inside the scope. Without one, they go when the
    driver's process ends.
    """
    folder = work_dir(spark, "scope")
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        _delete(spark, folder)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A folder of its own for one run, below the shared one."""
    name = f"{purpose}-{uuid.uuid4().hex}"
    if _scopes:
        return f"{_scopes[-1]}/{name}"
    application = f"{shared_dir(spark).rstrip('/')}/dumpweave/{spark.sparkContext.applicationId}"
    if application not in _applications:
        _applications.add(application)
        atexit.register(_forget, spark, application)
    return f"{application}/{name}"


_applications: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    with suppress(Exception):  # the session may be gone by then
        _delete(spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the shared folder; for what one step hands to the next."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read that.

    For large results that several later steps read. As with a checkpoint they
    outlive the executors that computed them; the table is also columnar, so
    each step takes only the columns and rows it needs, and joins are planned
    with its real size. ``options`` are those of the Parquet writer. What was
    shuffled to make the table goes as soon as it is written.
    """
    spark = df.sparkSession
    path = work_dir(spark, "stage")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, **options)
    finally:
        spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stage_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete the table behind a result of ``store`` that nothing reads any more."""
    _delete(stored.sparkSession, stored.stage_path)


def workers_find_library(spark: SparkSession) -> None:
    """Python workers import this package from where it lies, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def configure(spark: SparkSession) -> SparkSession:
    """Adaptive execution on, with hot join keys split even at an extra shuffle.

    All lookup joins here have one row per key on one side, so a hot key can
    be split on the other side without changing the result. Which side is
    broadcast is left to sizes measured at run time; nothing is forced. Sizes
    of files are estimated as unpacked, so that a small compressed table is
    not taken for a small one in memory. Tables that are dealt out alike by
    some of a join's keys are not dealt out again by all of them.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "4.0")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


# bytes of rows that are handed to a Python worker at a time
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by their bytes, not ten thousand at a time whatever their size.

    A batch of whole texts is held several times over, by the executor and by
    the worker. A smaller limit that the session has already stays.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit))
    if now > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out to all cores.

    Parsing is CPU work, and a small file of one row group is one task's. An
    input with at least a split per core is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
