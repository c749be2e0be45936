"""Small Spark helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dumpweave.plans.session import discard, small_batches, store


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], ddl: str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it yields dicts of columns."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from function(batch)

    return map_partition(df, every, ddl)


def map_partition(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str
) -> DataFrame:
    """Apply ``function`` to the non-empty batches of each partition; it yields dicts of columns."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for columns in function(batch for batch in batches if batch.num_rows):
                yield to_batch(columns, schema)
        finally:
            give_back_memory()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def give_back_memory() -> None:
    """Return freed memory to the system, as a worker stays while others run."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, type=field.type)
            for field, column in ((f, columns[f.name]) for f in schema)
        ],
        schema=schema,
    )


def small_table(spark: SparkSession, columns: dict, ddl: str) -> DataFrame:
    """A table of a few rows of the driver's; no Python worker is started to make it, as one is for a list of rows."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return spark.createDataFrame(pa.Table.from_batches([to_batch(columns, schema)]), ddl)


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The columns ``needed`` of ``docs``, all others in a struct ``_aside``; and what restores ``docs``' columns.

    No name that an operator uses inside can clash with a column it does not need.
    """
    others = [c for c in docs.columns if c not in needed]
    names = {c: f"c{i}" for i, c in enumerate(others)}
    held = [F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("_aside")] if others else []

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col("_aside")[names[c]].alias(c) if c in names else F.col(c) for c in docs.columns])

    return docs.select(*needed, *held), back


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_key(text: Column) -> Column:
    """Name of a text: equal for equal texts; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Edges of a task as stars: each node to the smallest one its task links it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        if len(root) > FOREST_NODES:
            yield _stars(root, find)
            root.clear()
    yield _stars(root, find)


# nodes that a task links by itself before it passes them on
FOREST_NODES = 1_000_000


def _stars(root: dict[int, int], find: Callable[[int], int]) -> dict:
    nodes = [x for x in root if root[x] != x]
    return {"a": nodes, "b": [find(x) for x in nodes]}


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the smallest node it reaches.

    Tasks link what they hold; then large-star and small-star in turn, until
    every node hangs on its label directly. The number of rounds grows with the
    logarithm of the longest path. Edges of a step are stored, so that a lost
    executor costs one step. A hub with very many edges is never gathered:
    minima are combined in the map tasks and joined back.
    """
    edges = store(map_partition(edges.select("a", "b").where("a <> b"), _local_forest, "a long, b long").distinct())
    while True:
        # stars: a node hangs on one other, which hangs on none
        child, parent = F.lit(1).alias("child"), F.lit(0).alias("child")
        ends = edges.select("a", child).union(edges.select(F.col("b").alias("a"), parent))
        loose = ends.groupBy("a").agg(F.sum("child").alias("n"), F.min("child").alias("least"))
        if loose.where("n > 1 or (n = 1 and least = 0)").isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        # large star: a node's larger neighbours move to its smallest neighbour
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            small_least.select("a", F.col("least").alias("b"))
        )
        former, edges = edges, store(small.where("a <> b").distinct())
        discard(former)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        roots.withColumn("label", F.col("node"))
    )


def file_system(path: str):
    """The Arrow file system and the plain path of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_output(path: str):
    """A stream to a new file on the file system of its URI; folders are made."""
    system, plain = file_system(path)
    system.create_dir(plain.rpartition("/")[0], recursive=True)
    return system.open_output_stream(plain, compression=None)


def open_input(path: str):
    """A file to read by ranges."""
    system, plain = file_system(path)
    return system.open_input_file(plain)


_held: dict[str, object] = {}


def once_per_worker(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept by a Python worker for later tasks; the last four names stay."""
    if name not in _held:
        while len(_held) >= 4:
            _held.pop(next(iter(_held)))
        _held[name] = build()
    return _held[name]
