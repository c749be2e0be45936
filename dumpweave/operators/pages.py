"""Selecting, cleaning, checking, deduplicating and comparing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import OTHER_NAMESPACE, TITLE_LENGTH
from dumpweave.functions.text import unslug
from dumpweave.functions.translit import transliterate
from dumpweave.plans.ordered import global_index
from dumpweave.plans.skew import SALTS, top_per_key


def article_pages(pages: DataFrame, namespace_mode: str = "colon") -> DataFrame:
    """Pages that are articles, with ``title_ascii`` beside the raw title.

    These are the pages that ``article_status`` keeps.
    """
    kept = article_status(pages, namespace_mode).where(F.col("status") == "kept").drop("status")
    return kept.withColumn("title_ascii", transliterate(F.col("title")))


def article_status(pages: DataFrame, namespace_mode: str = "colon") -> DataFrame:
    """All pages with ``status``: kept, or why a page is no article or not taken.

    ``colon`` leaves out titles with a colon inside, ``ns`` pages whose ``ns``
    is not 0. Redirects and titles above the length limit, counted before
    transliteration, are left out in both modes.
    """
    if namespace_mode == "colon":
        article = ~F.col("title").rlike(OTHER_NAMESPACE)
    elif namespace_mode == "ns":
        article = F.col("ns") == 0
    else:
        raise ValueError(f"unknown namespace_mode {namespace_mode!r}")
    status = (
        F.when(F.col("title").isNull(), "no title")
        .when(F.col("is_redirect"), "redirect")
        .when(~F.coalesce(article, F.lit(False)), "other namespace")
        .when(F.char_length("title") > TITLE_LENGTH, "long title")
        .otherwise("kept")
    )
    return pages.withColumn("status", status)


def pages_in_namespace(pages: DataFrame, namespace: int) -> DataFrame:
    """``page_id, title`` of dump pages of one namespace that are no redirects."""
    return pages.where(
        (F.col("namespace") == namespace) & (F.col("is_redirect") == 0)
    ).select("page_id", "title")


def clean_title(pages: DataFrame) -> DataFrame:
    """Add ``page_title`` (``_`` to space) and ``status``, kept or skipped by length."""
    cleaned = pages.withColumn("page_title", unslug(F.col("title")))
    kept = F.char_length("page_title") <= TITLE_LENGTH
    return cleaned.withColumn("status", F.when(kept, "kept").otherwise("skipped"))


def title_equals_ci(left: Column, right: Column | str) -> Column:
    return F.lower(left) == F.lower(right if isinstance(right, Column) else F.lit(right))


def find_by_title(df: DataFrame, value: str, column: str = "title") -> DataFrame:
    """All rows whose title equals ``value`` ignoring case."""
    return df.where(title_equals_ci(F.col(column), value))


def find_exact(df: DataFrame, order: list[str], **equal) -> DataFrame:
    """The first row, in ``order``, that has the given column values."""
    for column, value in equal.items():
        df = df.where(F.col(column) == F.lit(value))
    return df.orderBy(*order).limit(1)


def valid_page(pages: DataFrame) -> DataFrame:
    """Add ``reason``, NULL for a page whose arrays are complete and match in size."""

    def has_null(name):
        return F.exists(name, lambda x: x.isNull())

    reason = F.when(F.col("title").isNull(), "invalid title")
    for name in ("headings", "sections", "links"):
        reason = reason.when(F.col(name).isNull(), f"invalid {name}").when(
            has_null(name), f"invalid {name} element"
        )
    reason = reason.when(F.size("headings") != F.size("sections"), "sizes differ")
    return pages.withColumn("reason", reason)


def dedupe_by_title(
    pages: DataFrame,
    existing: DataFrame | None = None,
    key: str = "title",
) -> DataFrame:
    """Add ``status``: added for the page of a title that is loaded, else duplicate.

    Pages come in chunks of files, ``file_start, chunk, pos``. The earliest
    chunk wins, and within a chunk the last position, as chunks are emptied
    from the end. Titles in ``existing`` are duplicates whatever their place.
    Places are unique. The winners' places are found from the titles alone and
    combined in the map tasks, so whole pages are moved once.
    """
    place = F.struct("file_start", "chunk", (-F.col("pos")).alias("pos"))
    winners = pages.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_winner"))
    marked = pages.join(winners, F.col(key).eqNullSafe(F.col("_key")))
    fresh = F.col("_winner").eqNullSafe(place)
    if existing is not None:
        # only the titles that occur in the pages at hand are looked for
        seen = (
            existing.select(key)
            .join(pages.select(key), key, "left_semi")
            .distinct()
            .withColumn("_seen", F.lit(True))
        )
        marked = marked.join(seen, key, "left")
        fresh = fresh & F.col("_seen").isNull()
    status = F.when(fresh, "added").otherwise("duplicate")
    return marked.select(*pages.columns, status.alias("status"))


def duplicate_log(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col("status") == "duplicate").drop("status")


def limit_per_file(pages: DataFrame, n: int, salts: int = SALTS) -> DataFrame:
    """The first ``n`` pages of every file, in file order (``file_start, pos``)."""
    return top_per_key(
        pages, ["file_start"], [F.col("pos")], n, ["pos"], rank="_rank", salts=salts
    ).drop("_rank")


def article_count_longest_title(pages: DataFrame, per_file: bool = True) -> DataFrame:
    """Number of articles and longest title, the first of equal ones; over all files
    with ``per_file=False``."""
    longest = F.max_by(
        "title", F.struct(F.char_length("title"), -F.col("file_start"), -F.col("pos"))
    )
    grouped = pages.groupBy("file_start") if per_file else pages.groupBy()
    return grouped.agg(F.count("*").alias("n_articles"), longest.alias("longest_title"))


def load_report(loaded: DataFrame, by: list[str]) -> DataFrame:
    """Pages, additions, duplicates and errors per file, or per file and chunk."""

    def tally(status):
        return F.count_if(F.col("status") == status)

    return loaded.groupBy(*by).agg(
        F.count("*").alias("pages"),
        tally("added").alias("additions"),
        tally("duplicate").alias("duplicates"),
        tally("error").alias("errors"),
    )


def load_totals(loaded: DataFrame) -> DataFrame:
    """Rows per status over everything."""
    return loaded.groupBy("status").agg(F.count("*").alias("n_rows"))


def page_of_rows(df: DataFrame, key: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in key order.

    Rows are numbered range by range, so no task holds those before the page.
    """
    numbered = global_index(df, [F.col(k) for k in key], "_place")
    page = numbered.where((F.col("_place") >= offset) & (F.col("_place") < offset + limit))
    return page.orderBy("_place").drop("_place")


def page_after(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows after a key, for paging deep without reading the rows before."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def combine_chunks(*chunks: DataFrame) -> DataFrame:
    """All rows of all chunks, copies kept."""
    combined = chunks[0]
    for chunk in chunks[1:]:
        combined = combined.unionByName(chunk)
    return combined


def table_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def page_diff(old: DataFrame, new: DataFrame, key: str = "title") -> DataFrame:
    """Per page of two snapshots: added, removed, changed or same.

    All columns other than the key are compared; NULL equals NULL, also as a
    key. Where a key is repeated, equal pages are the same, of the rest as many
    as both have are changed, and what is left over is added or removed.
    """
    columns = [c for c in old.columns if c != key]

    def side(df: DataFrame, before: int, after: int) -> DataFrame:
        return df.select(
            F.col(key), F.struct(*columns).alias("_page"),
            F.lit(before).alias("_old"), F.lit(after).alias("_new"),
        )

    pages = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(key, "_page")
    counted = pages.agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    same = F.least("_old", "_new")
    by_key = counted.groupBy(key).agg(
        F.sum(same).alias("_same"),
        F.sum(F.col("_old") - same).alias("_old"),
        F.sum(F.col("_new") - same).alias("_new"),
    )
    changed = F.least("_old", "_new")
    outcomes = [
        ("same", F.col("_same")),
        ("changed", changed),
        ("removed", F.col("_old") - changed),
        ("added", F.col("_new") - changed),
    ]
    outcome = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), n.alias("n")) for s, n in outcomes]))
    told = by_key.select(key, outcome.alias("_o")).where(F.col("_o.n") > 0)
    return told.select(
        key, F.col("_o.status").alias("status"), F.explode(F.sequence(F.lit(1), F.col("_o.n"))).alias("_i")
    ).drop("_i")
