"""Checks of a dump's files, of the tables' integrity, and of title collisions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import QUALITY_LENGTH, TITLE_LENGTH
from dumpweave.functions.translit import transliterate, transliteration_status
from dumpweave.plans.barrier import once
from dumpweave.plans.ordered import global_index


def dump_contiguity(files: DataFrame) -> DataFrame:
    """One row: ``contiguous, last_valid_file`` for ``path, start_idx, end_idx``.

    By first id, every file must start right after the one before ends, and the
    first at 1; an overlap breaks this as well as a gap. The last valid file is
    the one before the first break, NULL if the first file breaks it, or the
    last file of all. Only what lies between known files can be missed.
    """
    placed = global_index(
        files.select("path", "start_idx", "end_idx"),
        [F.col("start_idx"), F.col("end_idx"), F.col("path")],
    )
    before = placed.select(
        (F.col("index") + 1).alias("index"),
        F.col("end_idx").alias("_end"),
        F.col("path").alias("_path"),
    )
    breaks = F.col("start_idx") != F.coalesce("_end", F.lit(0)) + 1
    return (
        placed.join(before, "index", "left")
        .agg(
            F.min(F.when(breaks, F.struct("index", "_path"))).alias("_break"),
            F.max_by("path", "index").alias("_last"),
        )
        .select(
            F.col("_break").isNull().alias("contiguous"),
            F.when(F.col("_break").isNull(), F.col("_last"))
            .otherwise(F.col("_break._path"))
            .alias("last_valid_file"),
        )
    )


def require_contiguous(files: DataFrame) -> None:
    """Raise FileNotFoundError unless the files follow each other."""
    found = dump_contiguity(files).first()
    if not found["contiguous"]:
        raise FileNotFoundError(f"dump is not contiguous after {found['last_valid_file']}")


# table: its key, its other unique columns, and columns with a length limit
_KEYS = {
    "text": (["title"], [], {"title": TITLE_LENGTH}),
    "page": (["page_id"], ["page_title"], {"page_title": TITLE_LENGTH}),
    "link": (["pl_from", "part"], [], {}),
    "talk": (["page_id"], ["page_title"], {"page_title": TITLE_LENGTH}),
    "quality": (["page_id"], [], {"page_quality": QUALITY_LENGTH}),
}
_PARENTS = [
    ("link", "pl_from", "page", "page_id"),
    ("talk", "page_title", "page", "page_title"),
    ("quality", "page_id", "talk", "page_id"),
]


def integrity_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, check_name, violations`` for the tables given.

    Repeated keys are counted as keys, missing parents and lengths as rows.
    """
    report = []
    for table, df in tables.items():
        key, unique, lengths = _KEYS[table]
        rows = {f"not null {c}": F.col(c).isNull() for c in key}
        rows |= {f"length {c}": F.char_length(c) > n for c, n in lengths.items()}
        if table == "link":
            rows["length pl_titles"] = F.exists(
                "pl_titles", lambda x: F.char_length(x) > TITLE_LENGTH
            )
        # all checks of single rows in one pass
        found = df.agg(*[F.count_if(wrong).alias(check) for check, wrong in rows.items()])
        report.append(
            found.unpivot([], list(rows), "check_name", "violations").withColumn(
                "table_name", F.lit(table)
            )
        )
        for columns in [key, *([c] for c in unique)]:
            repeated = df.groupBy(*columns).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
            report.append(_violations(repeated, table, f"unique {', '.join(columns)}"))
    for child, column, parent, target in _PARENTS:
        if child in tables and parent in tables:
            known = tables[parent].select(F.col(target).alias(column))
            # a NULL key refers to nothing, so it is no violation
            given = tables[child].select(column).where(F.col(column).isNotNull())
            orphans = given.join(known, column, "left_anti")
            report.append(_violations(orphans, child, f"{column} in {parent}"))
    return reduce(DataFrame.unionByName, report).select("table_name", "check_name", "violations")


def _violations(found: DataFrame, table: str, check: str) -> DataFrame:
    return found.agg(F.count("*").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), "violations"
    )


def translit_collisions(titles: DataFrame, title: str = "title") -> DataFrame:
    """ASCII forms that several distinct titles share, or that are empty.

    Here letters without a form are dropped, so that titles of such letters only show as empty.

    ``title_ascii, n_titles, first_title, last_title``. The titles themselves
    are listed by ``colliding_titles``, one per row, as one form (the empty
    one, say) may have any number.
    """
    grouped = (
        titles.select(F.col(title).alias("title"))
        .distinct()
        .groupBy(transliterate(F.col("title"), keep=False).alias("title_ascii"))
        .agg(
            F.count("*").alias("n_titles"),
            F.min("title").alias("first_title"),
            F.max("title").alias("last_title"),
        )
    )
    return grouped.where((F.col("n_titles") > 1) | (F.col("title_ascii") == ""))


def colliding_titles(titles: DataFrame, title: str = "title") -> DataFrame:
    """``title_ascii, title`` of all titles in a collision."""
    distinct = titles.select(F.col(title).alias("title")).distinct()
    forms = once(distinct, title_ascii=transliterate(F.col("title"), keep=False))
    collided = translit_collisions(titles, title).select("title_ascii")
    return forms.join(collided, "title_ascii", "left_semi").select("title_ascii", "title")


def untransliterated_titles(titles: DataFrame, title: str = "title") -> DataFrame:
    """``title`` of all distinct titles that keep letters without an ASCII form."""
    distinct = titles.select(F.col(title).alias("title")).distinct()
    return distinct.where(transliteration_status(F.col("title")) == "partly")
