"""Positions and running totals in a global order, without a one-task window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpweave.plans.session import store


def running_total(df: DataFrame, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows before this one; see ``running_totals``."""
    return running_totals(df, order, {out: weight})


def running_totals(df: DataFrame, order: list[Column], weights: Mapping[str, Column]) -> DataFrame:
    """Add for each of ``weights`` the sum of it over all rows before this one.

    ``order`` must tell rows apart (fold copies into a weight first). Rows are
    range-partitioned, which also spreads a hot leading key; each range is
    summed by itself, and the ranges' totals, one row per partition, are summed
    up and added. Range bounds are sampled, so the ranges are stored before two
    branches read them.
    """
    names = {out: f"_weight_{i}" for i, out in enumerate(weights)}
    ranged = store(
        df.repartitionByRange(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumns({names[out]: weight.cast("bigint") for out, weight in weights.items()})
    )
    per_range = ranged.groupBy("_range").agg(*[F.sum(n).alias(n) for n in names.values()])
    in_order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the shuffle above: a bound set by configuration
    starts = per_range.select(
        "_range", *[F.coalesce(F.sum(n).over(in_order), F.lit(0)).alias(f"{n}_start") for n in names.values()]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        ranged.withColumns({f"{n}_inside": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names.values()})
        .join(F.broadcast(starts), "_range")
        .withColumns({out: F.col(f"{n}_start") + F.col(f"{n}_inside") for out, n in names.items()})
        .drop("_range", *[f"{n}{x}" for n in names.values() for x in ("", "_start", "_inside")])
    )


def global_index(df: DataFrame, order: list[Column], out: str = "index") -> DataFrame:
    """Add a dense position 0.. in ``order``."""
    return running_total(df, order, F.lit(1), out)
