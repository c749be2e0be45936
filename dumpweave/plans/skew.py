"""First-of-key and top-of-key that never put a hot key into one task.

Joins on hot keys are split by adaptive execution (see ``session.configure``),
but windows are not: a key with a third of all rows would be sorted by one
task. The helpers here rank inside (key, salt) first, so that only the few
local winners of a key ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 4096
# up to this k Spark's own per-task limit before the shuffle is enough: a key
# then brings at most k rows from each task
SMALL_K = 100


def salt(unique: list[str], salts: int = SALTS) -> Column:
    """Bucket 0..salts-1 from columns that tell the rows of one key apart."""
    return F.pmod(F.xxhash64(*unique), F.lit(salts))


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the lowest ``order`` of every key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def mark_first(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    unique: list[str],
    flag: str = "is_first",
    salts: int = SALTS,
) -> DataFrame:
    """All rows, with ``flag`` true on the first row of every key.

    A row that is not first among its (key, salt) is settled there. The others,
    at most ``salts`` per key, meet in lane -1 for the final decision.
    """
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys, "_lane").orderBy(*order)
    return (
        df.withColumn("_salt", salt(unique, salts))
        .withColumn("_local", F.row_number().over(local) == 1)
        .withColumn("_lane", F.when(F.col("_local"), F.lit(-1)).otherwise(F.col("_salt")))
        .withColumn(flag, F.col("_local") & (F.row_number().over(final) == 1))
        .drop("_salt", "_local", "_lane")
    )


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    unique: list[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows of every key with their rank 1..k.

    For a larger k the rows are first cut to k per (key, salt); the final
    window then sees at most k * salts rows of a key.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    if k > SMALL_K:
        by_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt(unique, salts))
            .withColumn("_local", F.row_number().over(by_salt))
            .where(F.col("_local") <= k)
            .drop("_salt", "_local")
        )
    return df.withColumn(rank, F.row_number().over(by_key)).where(F.col(rank) <= k)
