"""Mixing sources to target weights by temperature, in blocks.

Each source's share of the tokens is raised to an exponent between 0 (all
sources alike) and 1 (as they are), and the powers are normalised to weights.
The exponent is bisected until the weights meet a target: a repetition limit,
or an entropy. Weights are realised under a budget of tokens: a source goes
through its documents in epochs; an epoch is a random permutation of the
source's blocks, and the last one ends in the block, and there at the document,
where the source's share of the budget is used up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpweave.llm.frames import small_table
from dumpweave.plans.session import store

BLOCK_TOKENS = 1 << 20
# the weights are worked out in the driver, with one row for each source
MOST_SOURCES = 1_000_000
STEPS = 60


@dataclass(frozen=True)
class Target:
    """Either ``repeats``, the most epochs of any source for one of the least repeated, or ``entropy`` in bits."""

    repeats: float | None = None
    entropy: float | None = None

    def __post_init__(self) -> None:
        if (self.repeats is None) == (self.entropy is None):
            raise ValueError("give either repeats or entropy")
        if self.repeats is not None and self.repeats < 1:
            raise ValueError("repeats is 1 at least")

    def within(self, shares: np.ndarray, exponent: float) -> bool:
        """Whether the weights do not go beyond the target."""
        weights = tempered(shares, exponent)
        if self.repeats is not None:
            epochs = weights / shares
            return epochs.max() / epochs.min() <= self.repeats
        return -(weights * np.log2(weights)).sum() <= self.entropy


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    powers = shares**exponent
    return powers / powers.sum()


def bisected_exponent(shares: np.ndarray, target: Target) -> float:
    """The smallest exponent whose weights stay within the target.

    Repetition and entropy both fall as the exponent grows. If equal weights are
    within the target it is 0; if the shares themselves are beyond it, 1.
    """
    if target.within(shares, 0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        middle = (lo + hi) / 2
        if target.within(shares, middle):
            hi = middle
        else:
            lo = middle
    return hi


def source_plan(docs: DataFrame, target: Target, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, tokens, weight, epochs, blocks) of each source of ``docs`` (source, n_tokens).

    Without a ``budget`` it is as large as lets the least repeated source be
    used exactly once, so that every document stays. Sources without tokens are
    used once. A null source is a source.
    """
    spark = docs.sparkSession
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = sorted(sums.limit(MOST_SOURCES + 1).collect(), key=lambda r: (r["source"] is not None, r["source"]))
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = np.array([float(r["tokens"] or 0) for r in rows])
    weights, epochs = np.zeros(len(rows)), np.ones(len(rows))
    own = tokens > 0
    if own.any():
        shares = tokens[own] / tokens.sum()
        weights[own] = tempered(shares, bisected_exponent(shares, target))
        size = budget if budget is not None else (tokens[own] / weights[own]).max()
        epochs[own] = weights[own] * size / tokens[own]
        # rounding must not cut the last document of a whole epoch
        near = np.rint(epochs)
        epochs = np.where(np.abs(epochs - near) < 1e-9, near, epochs)
    blocks = np.maximum(np.ceil(tokens / block_tokens), 1)
    return small_table(
        spark,
        {
            "source": [r["source"] for r in rows],
            "tokens": [int(t) for t in tokens],
            "weight": weights,
            "epochs": epochs,
            "blocks": [int(b) for b in blocks],
        },
        "source string, tokens long, weight double, epochs double, blocks long",
    )


def mixed(
    docs: DataFrame,
    tokens: Column,
    target: Target,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """The mixture: each row of ``docs`` (doc_id, source, and other columns) once for each epoch that takes it.

    ``tokens`` counts a row's tokens; null counts as 0. Added columns:
    ``mix_tokens``, ``mix_weight`` (of the source), ``mix_epoch`` from 0,
    ``mix_block`` and ``mix_place``, between 0 and 1: rows sorted by it hold the
    sources by their weights all along. Rows with equal ids and tokens are dealt
    alike; repeated rows stay repeated. An empty table gives no rows.
    """
    rows = docs.withColumn("mix_tokens", F.coalesce(tokens, F.lit(0)).cast("long"))
    plan = source_plan(rows.select("source", F.col("mix_tokens").alias("n_tokens")), target, budget, block_tokens)
    plan = plan.withColumnRenamed("source", "_source").withColumnRenamed("weight", "mix_weight")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    name = F.coalesce(F.col("source"), F.lit(""))
    rows = rows.withColumns(
        {
            "_draw": F.xxhash64(F.lit(seed), "doc_id", "mix_tokens"),
            "mix_block": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("blocks")),
            "_whole": F.floor("epochs").cast("int"),
        }
    )
    # the epoch that is cut short: its blocks in their order, with the tokens before each
    order = F.xxhash64(F.lit(seed + 2), name, F.col("_whole"), F.col("mix_block"))
    sizes = (
        rows.groupBy("source", "_whole", "epochs", "tokens", "mix_block")
        .agg(F.sum("mix_tokens").alias("_size"))
        .withColumn("_order", order)
    )
    ahead = Window.partitionBy("source").orderBy("_order", "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    quota = (F.col("epochs") - F.col("_whole")) * F.col("tokens")
    cut = sizes.withColumn("_left", quota - F.coalesce(F.sum("_size").over(ahead), F.lit(0))).where("_left > 0")
    cut = store(cut.select(F.col("source").alias("_cut_source"), F.col("mix_block").alias("_cut_block"), "_size", "_left"))
    at = F.col("source").eqNullSafe(F.col("_cut_source")) & (F.col("mix_block") == F.col("_cut_block"))
    taken = rows.join(cut, at)
    # a block that is used up in part: its documents in their order, a block's worth at most
    within = Window.partitionBy("source", "mix_block").orderBy("_draw").rowsBetween(Window.unboundedPreceding, -1)
    edge = taken.where("_size > _left").withColumn("_before", F.coalesce(F.sum("mix_tokens").over(within), F.lit(0)))
    last = taken.where("_size <= _left").drop(*cut.columns).unionByName(
        edge.where("_before < _left").drop("_before", *cut.columns)
    )
    epochs = F.explode(F.sequence(F.lit(0), F.col("_whole") - 1))
    whole = rows.where("_whole > 0").withColumn("mix_epoch", epochs)
    every = whole.unionByName(last.withColumn("mix_epoch", F.col("_whole")))
    # a block's place in its epoch is a random number that all its documents share
    unit = F.pmod(F.xxhash64(F.lit(seed + 2), name, F.col("mix_epoch"), F.col("mix_block")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = (F.col("mix_epoch") + unit) / F.greatest("epochs", F.lit(1.0))
    return every.withColumn("mix_place", F.least(place, F.lit(1.0))).drop(
        "_source", "tokens", "epochs", "blocks", "_draw", "_whole"
    )


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a null, empty or blank text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
