"""Quality grades and the page, talk and quality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import GRADES, QUALITY_CLASS, TITLE_LENGTH
from dumpweave.plans.skew import first_per_key


def quality_from_category(categories: DataFrame) -> DataFrame:
    """Add ``quality`` from a category such as ``B-Class_x``; others are dropped."""
    quality = F.regexp_extract("category", QUALITY_CLASS, 1)
    return categories.withColumn("quality", quality).where(F.col("quality") != "")


def first_quality_per_page(qualities: DataFrame, mode: str = "first") -> DataFrame:
    """One ``quality`` per ``id``: the first by ``seq``, or the best grade.

    Combined before the shuffle, so a page with very many rows costs no more
    than one row per task. A grade outside the list ranks after all of them.
    """
    if mode == "first":
        order = F.col("seq")
    elif mode == "best":
        rank = F.coalesce(
            F.nullif(F.array_position(F.lit(GRADES), F.col("quality")), F.lit(0)),
            F.lit(len(GRADES) + 1),
        )
        order = F.struct(rank.alias("rank"), F.col("seq"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return first_per_key(qualities.select("id", "seq", "quality"), ["id"], order)


def sort_qualities(qualities: DataFrame) -> DataFrame:
    """By id, input order kept among equal ids."""
    return qualities.orderBy("id", "seq")


def talk_of_existing_pages(talk: DataFrame, page: DataFrame) -> DataFrame:
    """Add ``status``: kept, or skipped with the reason length or no_page.

    Titles that are too long are not looked up.
    """
    titles = page.select("page_title").distinct().withColumn("_found", F.lit(True))
    status = (
        F.when(F.char_length("page_title") > TITLE_LENGTH, "skipped_length")
        .when(F.col("_found").isNull(), "skipped_no_page")
        .otherwise("kept")
    )
    return talk.join(titles, "page_title", "left").withColumn("status", status).drop("_found")


def quality_of_existing_talk(quality: DataFrame, talk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) quality rows, by whether ``page_id`` is a talk page."""
    ids = talk.select("page_id")
    return quality.join(ids, "page_id", "left_semi"), quality.join(ids, "page_id", "left_anti")


def page_quality(page: DataFrame, talk: DataFrame, quality: DataFrame) -> DataFrame:
    """``page_id, page_title, talk_id, page_quality`` of all graded pages."""
    graded = talk.withColumnRenamed("page_id", "talk_id").join(
        quality.withColumnRenamed("page_id", "talk_id"), "talk_id"
    )
    return page.join(graded, "page_title").select(
        "page_id", "page_title", "talk_id", "page_quality"
    )


def page_links_quality(
    link: DataFrame, page: DataFrame, talk: DataFrame, quality: DataFrame
) -> DataFrame:
    """Link rows of graded pages. Filter it on ``pl_from`` for one page; the
    filter reaches the scans of ``link`` and ``page``."""
    graded = page_quality(page, talk, quality)
    return link.join(graded, link["pl_from"] == graded["page_id"]).select(
        "pl_from", "page_title", "page_quality", *[c for c in link.columns if c != "pl_from"]
    )


def quality_walk(quality: DataFrame, talk: DataFrame, page: DataFrame) -> DataFrame:
    """Every quality row with its talk page's and page's title, NULL where missing."""
    titles = page.select(F.col("page_title"), F.col("page_id").alias("content_page_id"))
    return (
        quality.join(talk, "page_id", "left")
        .join(titles, "page_title", "left")
        .select(
            F.col("page_id").alias("talk_id"), "page_quality", "page_title", "content_page_id"
        )
    )
