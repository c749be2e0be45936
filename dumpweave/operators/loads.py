"""Loading dumps into tables, with a log of what became of every page.

A dump is parsed once, into a stage table that holds good rows and rejects side
by side. All that follows reads columns of that table: titles to find
duplicates, whole pages to write them, and the rows of the log. Totals are
observed while the tables are written.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dumpweave.fixed_values import DUMP_FILE_NAME, PAGES_PER_FILE, TITLE_LENGTH
from dumpweave.functions.text import unslug
from dumpweave.functions.translit import transliterate
from dumpweave.functions.wikitext import extract_links, extract_sections
from dumpweave.operators.pages import article_status, dedupe_by_title, load_report, valid_page
from dumpweave.operators.quality import talk_of_existing_pages
from dumpweave.plans.ordered import global_index
from dumpweave.plans.session import store
from dumpweave.sinks.tables import write_table
from dumpweave.sources.sql_dump import marked_sql_dump
from dumpweave.sources.tables import read_table
from dumpweave.sources.xml_dump import marked_xml_pages

STATUSES = ("added", "duplicate", "skipped", "left out", "error")
LOG, REJECTED = "load_log", "rejected"


@dataclass
class Load:
    """What a load has written: its tables, its log, its rejects, and rows per status."""

    tables: Mapping[str, DataFrame]
    log: DataFrame
    rejected: DataFrame
    totals: Mapping[str, int]

    def report(self, *by: str) -> DataFrame:
        """Pages, additions, duplicates and errors, by columns of the log; what is left out is no page."""
        return load_report(self.log.where(F.col("status") != "left out"), list(by))

    def status_totals(self, spark: SparkSession) -> DataFrame:
        """``status, n_rows``, as observed while the log was written."""
        rows = [(s, n) for s, n in self.totals.items() if n]
        return spark.createDataFrame(rows, "status string, n_rows long")


def _write_log(log: DataFrame, rejected: DataFrame, root: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    seen = Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    log.observe(seen, *counts).write.mode("overwrite").parquet(f"{root}/{LOG}")
    rejected.write.mode("overwrite").parquet(f"{root}/{REJECTED}")
    spark = log.sparkSession
    back = [spark.read.schema(df.schema).parquet(f"{root}/{name}") for df, name in ((log, LOG), (rejected, REJECTED))]
    return *back, {s: seen.get[s] for s in STATUSES}


# --- XML dump to text -------------------------------------------------------------------


def staged_pages(records: DataFrame, namespace_mode: str = "colon") -> DataFrame:
    """Every page of ``records`` (file, value), parsed and judged by itself, as a stored table.

    Columns: row (tells rows apart), file, file_start, id, title, status, reason,
    headings, sections, links, rejected. Status is ``error`` for an element that
    is not well formed or a page that is not valid (or has an empty title), ``left out`` for what is no
    article, else ``kept``. Texts of articles only are taken apart.
    """
    marked = article_status(marked_xml_pages(records), namespace_mode)
    broken = F.col("rejected").isNotNull()
    untitled = (F.col("status") == "no title") | (F.col("title") == "")
    reason = (
        F.when(broken, "not well formed").when(untitled, "invalid title")
        .when(F.col("status") != "kept", F.col("status"))
    )
    status = F.when(broken | untitled, "error").when(F.col("status") != "kept", "left out").otherwise("kept")
    marked = marked.select(
        "file", F.regexp_extract("file", DUMP_FILE_NAME, 4).try_cast("bigint").alias("file_start"), "id",
        transliterate(F.col("title")).alias("title"), status.alias("status"), reason.alias("reason"), "rejected",
        F.when(F.col("status") == "kept", F.col("text")).alias("text"),
    )
    parsed = extract_sections(marked).withColumn("links", extract_links(F.col("text"))).drop("text")
    checked = valid_page(parsed.withColumnRenamed("reason", "before"))
    wrong = (F.col("status") == "kept") & F.col("reason").isNotNull()
    return store(checked.select(
        F.monotonically_increasing_id().alias("row"), "file", "file_start", "id", "title",
        F.when(wrong, "error").otherwise(F.col("status")).alias("status"),
        F.when(wrong, F.col("reason")).otherwise(F.col("before")).alias("reason"),
        "headings", "sections", "links", "rejected",
    ))


def load_text(
    records: DataFrame,
    root: str,
    existing: DataFrame | None = None,
    namespace_mode: str = "colon",
    chunk_pages: int = PAGES_PER_FILE,
) -> Load:
    """Load an XML dump, ``records`` (file, value), as table ``text`` below ``root``.

    A page's chunk is its place among the articles of its file, by page id, in
    ``chunk_pages``. Of equal titles one page is added, as ``dedupe_by_title``
    settles it, none if ``existing`` (title) has the title; titles are compared
    as they are stored, spelled out in ASCII. Pages that are not valid and
    elements that are not well formed are errors; the latter have no place and
    count for their file. A file whose name tells no first page id has NULL there.

    The log has file_start, chunk, id, title, status and reason of every page;
    rejects are file and value.
    """
    staged = staged_pages(records, namespace_mode)
    kept = staged.where(F.col("status") == "kept").select("row", "file_start", "id", "title")
    placed = global_index(kept, [F.asc_nulls_first("file_start"), F.asc_nulls_first("id"), F.asc("row")], "at")
    placed = store(placed)
    first = placed.groupBy(F.col("file_start").alias("_file")).agg(F.min("at").alias("_first"))
    placed = placed.join(first, F.col("file_start").eqNullSafe(F.col("_file")))
    pos = F.col("at") - F.col("_first")
    placed = placed.select("row", "file_start", "title", F.floor(pos / chunk_pages).alias("chunk"), pos.alias("pos"))
    settled = store(dedupe_by_title(placed, existing).select("row", "chunk", F.col("status").alias("_settled")))

    text = staged.where(F.col("status") == "kept").join(settled.where("_settled = 'added'").select("row"), "row")
    write_table(text, root, "text")
    narrow = staged.select("row", "file_start", "id", "title", "status", "reason").join(settled, "row", "left")
    log = narrow.select(
        "file_start", "chunk", "id", "title", F.coalesce("_settled", "status").alias("status"), "reason"
    )
    rejected = staged.where(F.col("rejected").isNotNull()).select("file", F.col("rejected").alias("value"))
    log, rejected, totals = _write_log(log, rejected, root)
    return Load({"text": read_table(staged.sparkSession, root, "text")}, log, rejected, totals)


# --- SQL page dump to page and talk -------------------------------------------------------


def load_page_tables(lines: DataFrame, root: str) -> Load:
    """Load the INSERT lines of a page dump as tables ``page`` and ``talk`` below ``root``.

    ``page`` has the pages of namespace 0 that are no redirects, ``talk`` those
    of namespace 1 whose title is a page's. Titles above the length limit, and
    talk pages without a page, are skipped. What the lines hold beside tuples,
    and tuples without id or title, are errors.

    The log has table_name, page_id, page_title, status and reason of every
    tuple and reject; rejects are value.
    """
    marked = store(marked_sql_dump(lines, "page"))
    tuples = marked.where("is_tuple").select(
        F.when(F.col("namespace") == 0, "page").when(F.col("namespace") == 1, "talk").alias("table_name"),
        "page_id", unslug(F.col("title")).alias("page_title"), "is_redirect",
    )
    reason = (
        F.when(F.col("page_id").isNull(), "invalid page_id")
        .when(F.col("page_title").isNull(), "invalid title")
        .when(F.col("table_name").isNull(), "other namespace")
        .when(~F.coalesce(F.col("is_redirect") == 0, F.lit(False)), "redirect")
        .when(F.char_length("page_title") > TITLE_LENGTH, "long title")
    )
    status = (
        F.when(F.col("reason").isNull(), "added").when(F.col("reason").startswith("invalid"), "error")
        .when(F.col("reason") == "long title", "skipped").otherwise("left out")
    )
    judged = tuples.withColumn("reason", reason).withColumn("status", status).drop("is_redirect")
    good = judged.where(F.col("status") == "added")
    page = good.where(F.col("table_name") == "page")
    talk = talk_of_existing_pages(good.where(F.col("table_name") == "talk").drop("status", "reason"), page)
    talk = talk.withColumn("reason", F.when(F.col("status") != "kept", "no page"))
    talk = store(talk.withColumn("status", F.when(F.col("reason").isNull(), "added").otherwise("skipped")))
    write_table(page, root, "page")
    write_table(talk.where(F.col("status") == "added"), root, "talk")

    rejected = marked.where(F.col("rejected").isNotNull()).select(F.col("rejected").alias("value"))
    columns = ["table_name", "page_id", "page_title", "status", "reason"]
    errors = rejected.select(
        *[F.lit(None).cast(t).alias(c) for c, t in zip(columns, ("string", "long", "string"), strict=False)],
        F.lit("error").alias("status"), F.lit("no tuple").alias("reason"),
    )
    rest = judged.where((F.col("table_name") != "talk") | F.col("table_name").isNull() | (F.col("status") != "added"))
    log = rest.select(*columns).unionByName(talk.select(*columns)).unionByName(errors)
    log, rejected, totals = _write_log(log, rejected, root)
    spark = marked.sparkSession
    return Load({n: read_table(spark, root, n) for n in ("page", "talk")}, log, rejected, totals)
