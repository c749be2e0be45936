"""Columns and parts of them that are computed once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and columns refer to without repeating them.

    A filter on a derived column is pushed below it, with its expression copied
    in. For parsing that means parsing again for every mention. The output of a
    generator is left where it is.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` mentions it.

    Inside conditions and functions of arrays Spark repeats an expression for
    every mention; mentions in one another multiply.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))
