"""Writing the relational tables, and the gate before a reload."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.sources.tables import SCHEMAS

MANIFESTS, VERSIONS = "_manifests", "_versions"


def conform(df: DataFrame, name: str) -> DataFrame:
    """Exactly the columns and types of a table."""
    return df.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]))


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    conform(df, name).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def write_tables(tables: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        write_table(df, root, name, mode)


def rebuild_tables(
    spark: SparkSession, tables: Mapping[str, DataFrame], root: str, keep: tuple[str, ...] = ("text",)
) -> None:
    """Replace all tables but those in ``keep``; one that is not given becomes empty."""
    for name, schema in SCHEMAS.items():
        if name not in keep:
            write_table(tables.get(name, spark.createDataFrame([], schema)), root, name)


# --- rebuilding all at once ---------------------------------------------------------------
# A set of tables is a manifest, a small file that names the folder of each table. It is written
# under another name and renamed last, so that there is always one whole newest set.


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{MANIFESTS}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the sets that were finished, in order."""
    folder, system, _ = _folder(spark, root)
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    row = spark.read.schema("name string, folder string").json(f"{root.rstrip('/')}/{MANIFESTS}/{version:012d}.json")
    return {r["name"]: r["folder"] for r in row.collect()}


def read_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one set, by default the newest one.

    What is read stays of that set, also when another one is finished meanwhile.
    """
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(root)
    folders = _manifest(spark, root, known[-1] if version is None else version)
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{folder}") for name, folder in folders.items()}


def rebuild_version(
    spark: SparkSession, tables: Mapping[str, DataFrame], root: str, keep: tuple[str, ...] = ("text",)
) -> int:
    """Write a new set of tables and make it the newest one; returns its number.

    A table in ``keep`` that is not given stays the one of the set before; any other that
    is not given becomes empty. Readers see the set before until all tables of
    this one are written. If two rebuilds end at once, one of them fails.
    """
    known = versions(spark, root)
    before = _manifest(spark, root, known[-1]) if known else {}
    version, run = (known[-1] + 1 if known else 1), uuid.uuid4().hex
    folders = {}
    for name, schema in SCHEMAS.items():
        if name in keep and name not in tables and name in before:
            folders[name] = before[name]
            continue
        folders[name] = f"{VERSIONS}/{version:012d}-{run}/{name}"
        conform(tables.get(name, spark.createDataFrame([], schema)), name).write.parquet(f"{root.rstrip('/')}/{folders[name]}")
    folder, system, path = _folder(spark, root)
    system.mkdirs(folder)
    draft, final = path(folder, f"{run}.draft"), path(folder, f"{version:012d}.json")
    out = system.create(draft, False)
    out.write(bytearray("".join(json.dumps({"name": n, "folder": f}) + "\n" for n, f in folders.items()).encode()))
    out.close()
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        raise FileExistsError(f"version {version} of {root} was made by another rebuild")
    return version


def expected_count_gate(df: DataFrame, expected: int) -> DataFrame:
    """One row: the table's rows, those expected, and whether a load can be skipped."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(expected).cast("bigint").alias("expected"),
        (F.col("n_rows") == expected).alias("is_full"),
    )
