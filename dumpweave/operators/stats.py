"""Summaries of lengths and shares of unknown tokens.

Lengths are first counted per value, combined in the map tasks. What is left
is one row per distinct length, whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import PERCENTILES, SPECIAL_TOKENS
from dumpweave.functions.text import lead_tokens


def _counted(df: DataFrame, length: str) -> DataFrame:
    counted = df.groupBy(F.col(length).alias("x")).agg(F.count(length).alias("n"))
    return counted.where(F.col("n") > 0)  # drops pages without a length, after counting


def length_summary(df: DataFrame, length: str = "length") -> DataFrame:
    """One row: largest, mean, median, sum."""
    total = F.sum(F.col("x") * F.col("n"))
    return _counted(df, length).agg(
        F.max("x").alias("max_length"),
        (total / F.sum("n")).alias("mean_length"),
        F.percentile("x", 0.5, F.col("n")).alias("median_length"),
        total.alias("sum_length"),
    )


def length_percentiles(
    df: DataFrame, length: str = "length", shares: list[float] = PERCENTILES
) -> DataFrame:
    """``share, value``: exact percentiles, interpolated between neighbours."""
    values = _counted(df, length).agg(
        F.percentile("x", list(shares), F.col("n")).alias("values")
    )
    return values.select(F.posexplode("values").alias("_at", "value")).select(
        F.element_at(F.lit(list(shares)), F.col("_at") + 1).alias("share"), "value"
    )


#: Accuracy of a sketch: its rank error is about 1.33 % for k = 200, and falls nearly as 1 / k.
SKETCH_K = 800
SKETCH_ERROR = 0.005


def length_sketches(df: DataFrame, by: list[str], length: str = "length", k: int = SKETCH_K) -> DataFrame:
    """``by, sketch, n``: a mergeable quantile sketch of the lengths of each group, of bounded size.

    Sketches are made in the map tasks. Stored, those of files that were loaded
    long ago need not be made again.
    """
    return df.where(F.col(length).isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_bigint(F.col(length).cast("bigint"), F.lit(k)).alias("sketch"), F.count("*").alias("n")
    )


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, sketch, n`` of all groups that agree in ``by``; one row without it."""
    return sketches.groupBy(*(by or [])).agg(
        F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n")
    )


def sketched_percentiles(sketches: DataFrame, shares: list[float] = PERCENTILES) -> DataFrame:
    """``share, value`` beside the other columns: a length whose rank is the share's to ``SKETCH_ERROR``, of each sketch."""
    values = F.array(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(s)) for s in shares])
    kept = [c for c in sketches.columns if c != "sketch"]
    found = sketches.where("n > 0").select(*kept, F.posexplode(values).alias("_at", "value"))
    return found.select(*kept, F.element_at(F.lit(list(shares)), F.col("_at") + 1).alias("share"), "value")


def length_histogram(df: DataFrame, length: str = "length", bins: int = 10) -> DataFrame:
    """``bin, lower, upper, n`` for equal bins from least to most, the last one closed.

    Empty bins are listed. If all lengths are equal they get a range of 1.
    """
    counted = _counted(df, length)
    ranged = counted.select(
        F.col("x").cast("double").alias("x"),
        "n",
        counted.agg(F.min("x").cast("double")).scalar().alias("_low"),
        counted.agg(F.max("x").cast("double")).scalar().alias("_high"),
    )
    pad = F.when(F.col("_low") == F.col("_high"), 0.5).otherwise(0.0)
    ranged = ranged.select(
        "x", "n", (F.col("_low") - pad).alias("_low"), (F.col("_high") + pad).alias("_high")
    )
    number = F.least(F.width_bucket("x", "_low", "_high", F.lit(bins)), F.lit(bins))
    filled = ranged.groupBy(number.alias("bin"), "_low", "_high").agg(F.sum("n").alias("n"))
    row = filled.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"),
        F.first("_low").alias("_low"),
        ((F.first("_high") - F.first("_low")) / bins).alias("_width"),
    ).withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    return row.select(
        "bin",
        (F.col("_low") + (F.col("bin") - 1) * F.col("_width")).alias("lower"),
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("upper"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def unknown_share(
    pages: DataFrame, vocabulary: DataFrame, cap: int | None = None, **options
) -> DataFrame:
    """One row: lead tokens that ``vocabulary`` (``token``) lacks, all lead tokens
    with the special ones, and the percentage.

    Tokens are counted before they are looked up, so a frequent one is looked
    up once. The special tokens of a page are carried as NULL tokens.
    """
    marks = F.array_repeat(F.lit(None).cast("string"), SPECIAL_TOKENS)
    counted = (
        lead_tokens(pages, cap, **options)
        .select(F.explode(F.concat(F.col("lead"), marks)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    known = vocabulary.select("token").distinct().withColumn("_known", F.lit(True))
    unknown = F.col("token").isNotNull() & F.col("_known").isNull()
    return (
        counted.join(known, "token", "left")
        .agg(
            F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("n_unknown"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        )
        .withColumn("percent_unknown", 100 * F.col("n_unknown") / F.nullif("n_tokens", F.lit(0)))
    )
