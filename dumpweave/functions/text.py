"""Words, terms, lines, slugs and colours."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import SPECIAL_TOKENS, STOP_WORDS, TERM, TOKEN
from dumpweave.plans.barrier import once


def remove_stopwords(
    text: Column, first: int | None = None, stop_words: Sequence[str] = STOP_WORDS
) -> Column:
    """Words not in the list, joined by one space.

    A word is a run between white space, so punctuation stays attached and
    ``the,`` is kept. ``first`` keeps that many words, counted after removal.
    """
    words = F.filter(
        F.split(text, r"(?U)\s+"), lambda w: (w != "") & ~F.lower(w).isin(list(stop_words))
    )
    if first is not None:
        words = F.slice(words, 1, first)
    return F.array_join(words, " ")


def collapse_lines(text: Column) -> Column:
    """Trim every line, drop blank ones, join the rest with nothing between."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(trimmed, "")


def tokenize_terms(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of word characters, case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def slug(title: Column) -> Column:
    return F.translate(title, " ", "_")


def unslug(title: Column) -> Column:
    return F.translate(title, "_", " ")


def colour_by_attribute(value: Column, colours: Mapping[object, str], other: str | None = None):
    """Colour of an attribute value."""
    chosen = F.lit(other)
    for key, colour in colours.items():
        chosen = F.when(value == F.lit(key), F.lit(colour)).otherwise(chosen)
    return chosen


def lead_tokens(
    df: DataFrame,
    cap: int | None = None,
    tokenizer: Callable[[Column], Column] = tokens,
) -> DataFrame:
    """Add ``lead``, the tokens of ``sections[0]``; NULL if there is no section.

    With a ``cap`` they are cut so that they and the two special tokens a model
    adds fit it.

    ``tokenizer`` maps a text column to an array column; a sub-word model can
    be plugged in as a pandas UDF.
    """
    first = F.get("sections", F.lit(0))
    found = tokenizer(first)
    if cap is not None:
        found = F.slice(found, 1, cap - SPECIAL_TOKENS)
    return once(df, lead=F.when(first.isNotNull(), found))


def lead_token_length(df: DataFrame, cap: int | None = None, **options) -> DataFrame:
    """Add ``length``: tokens of the lead with the special ones, 0 without a section."""
    with_lead = lead_tokens(df, cap, **options)
    length = F.when(F.col("lead").isNotNull(), F.size("lead") + SPECIAL_TOKENS).otherwise(0)
    return with_lead.withColumn("length", length.cast("bigint")).drop("lead")
