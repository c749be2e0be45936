"""The relational tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARRAY = T.ArrayType(T.StringType())
SCHEMAS = {
    "text": T.StructType()
    .add("title", T.StringType())
    .add("headings", _ARRAY)
    .add("sections", _ARRAY)
    .add("links", _ARRAY),
    "page": T.StructType().add("page_id", T.LongType()).add("page_title", T.StringType()),
    # one row per page, except that a page with very many links has several parts
    "link": T.StructType().add("pl_from", T.LongType()).add("part", T.LongType()).add("pl_titles", _ARRAY),
    "talk": T.StructType().add("page_id", T.LongType()).add("page_title", T.StringType()),
    "quality": T.StructType().add("page_id", T.LongType()).add("page_quality", T.StringType()),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in SCHEMAS}
