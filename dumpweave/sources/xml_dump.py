"""Multistream bz2 XML dumps: the files of a dump and the pages in them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.fixed_values import DUMP_FILE_NAME, VALID_DUMP_FILE
from dumpweave.plans.barrier import once

PAGE_SCHEMA = (
    "title string, ns bigint, id bigint, redirect struct<_title:string>, "
    "revision struct<id:bigint, text:struct<_VALUE:string,_bytes:bigint>>, _broken string"
)


def dump_files(paths: DataFrame) -> DataFrame:
    """Files of a split dump among ``path``: ``path, start_idx, end_idx``.

    An index that is not a number is NULL; see ``valid_file_range``.
    """
    return paths.where(F.col("path").rlike(DUMP_FILE_NAME)).select(
        "path",
        F.regexp_extract("path", DUMP_FILE_NAME, 4).try_cast("bigint").alias("start_idx"),
        F.regexp_extract("path", DUMP_FILE_NAME, 5).try_cast("bigint").alias("end_idx"),
    )


def dump_file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Dump files of a folder by first page id. Only names are read, no content."""
    try:
        listing = spark.read.format("binaryFile").load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(folder) from error
        raise
    names = listing.inputFiles()
    if len(names) == 1 and names[0].rstrip("/").endswith(folder.rstrip("/")):
        raise NotADirectoryError(folder)
    files = dump_files(listing.select("path"))
    bad = files.where(F.col("start_idx").isNull() | F.col("end_idx").isNull()).first()
    if bad is not None:
        raise ValueError(f"page range of {bad['path']} is not numeric")
    return files.orderBy("start_idx")


def valid_dump_file(paths: DataFrame) -> DataFrame:
    """Add ``is_valid``: the name has exactly the suffixes .xml-p..p.. and .bz2."""
    return paths.withColumn("is_valid", F.col("path").rlike(VALID_DUMP_FILE))


def valid_file_range(files: DataFrame) -> DataFrame:
    """Add ``reason``, NULL for a usable range; first and last id may be equal."""
    return files.withColumn(
        "reason",
        F.when(F.col("path").isNull(), "no path")
        .when(F.col("start_idx").isNull(), "start_idx is no integer")
        .when(F.col("end_idx").isNull(), "end_idx is no integer")
        .when(F.col("start_idx") > F.col("end_idx"), "start_idx is above end_idx"),
    )


def parse_xml_pages(records: DataFrame) -> DataFrame:
    """Pages from ``value``, each holding at most one ``<page>`` element.

    Columns: ``title, ns, id, is_redirect, redirect_title, rev_id, text`` and
    ``file`` if the input has it. Empty text is ''. Elements that are not well
    formed give no page; ``rejected_xml_pages`` has them.
    """
    return _pages(_parsed(records).where(F.col("p._broken").isNull()))


def rejected_xml_pages(records: DataFrame) -> DataFrame:
    """``value`` (and ``file``) of the ``<page>`` elements that are not well formed."""
    keep = ["file"] if "file" in records.columns else []
    return _parsed(records).where(F.col("p._broken").isNotNull()).select(*keep, "value")


def marked_xml_pages(records: DataFrame) -> DataFrame:
    """Pages and rejects in one pass: the columns of ``parse_xml_pages`` and ``rejected``.

    ``rejected`` is the ``<page>`` element where it is not well formed, else NULL.
    """
    return _pages(_parsed(records), F.when(F.col("p._broken").isNotNull(), F.col("value")).alias("rejected"))


def _parsed(records: DataFrame) -> DataFrame:
    page = F.concat(F.regexp_extract("value", r"(?s)<page>.*", 0), F.lit("</page>"))
    page = F.regexp_replace(page, r"(?s)(</page>)\s*</page>\s*$", "$1")
    options = {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_broken"}
    return once(
        records.where(F.col("value").contains("<page>")), p=F.from_xml(page, PAGE_SCHEMA, options)
    )


def _pages(parsed: DataFrame, *more: Column) -> DataFrame:
    keep = ["file"] if "file" in parsed.columns else []
    return parsed.select(
        *keep,
        F.col("p.title").alias("title"),
        F.col("p.ns").alias("ns"),
        F.col("p.id").alias("id"),
        F.col("p.redirect").isNotNull().alias("is_redirect"),
        F.col("p.redirect._title").alias("redirect_title"),
        F.col("p.revision.id").alias("rev_id"),
        F.coalesce("p.revision.text._VALUE", F.lit("")).alias("text"),
        *more,
    )


def read_xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of one or more .xml-p..p..bz2 files, with the ``file`` they are in.

    Records end at ``</page>``, so the text reader can split even one large
    bz2 file among tasks, which a row-tag XML scan of the file cannot.
    """
    return parse_xml_pages(read_xml_records(spark, path))


def read_xml_pages_between(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """Pages of a dump folder with an ``id`` from ``first`` to ``last``.

    File names tell which ids are inside, so only files that may hold some are
    opened. Without any there are no pages.
    """
    files = dump_file_listing(spark, folder).where((F.col("end_idx") >= first) & (F.col("start_idx") <= last))
    paths = [row["path"] for row in files.select("path").collect()]  # one for each file
    if not paths:
        empty = spark.createDataFrame([], "value string, file string")
        return parse_xml_pages(empty)
    return parse_xml_pages(read_xml_records(spark, paths)).where(F.col("id").between(first, last))


def read_xml_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``, each with at most one ``<page>`` element, and its ``file``."""
    records = spark.read.option("lineSep", "</page>").text(path)
    if not records.inputFiles():
        raise FileNotFoundError(path)
    return records.select("value", F.col("_metadata.file_path").alias("file"))
