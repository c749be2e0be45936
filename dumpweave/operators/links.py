"""Links: filtering, grouping by page, resolving, counting, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import TRAILING_CHUNKS
from dumpweave.functions.text import unslug
from dumpweave.plans.ordered import global_index, running_total, running_totals
from dumpweave.plans.session import store
from dumpweave.plans.skew import SALTS, top_per_key

PART_LINKS = 100_000


def ns0_links(links: DataFrame) -> DataFrame:
    """``pl_from, title`` of links from namespace 0 to namespace 0."""
    return links.where((F.col("from_namespace") == 0) & (F.col("namespace") == 0)).select(
        "pl_from", "title"
    )


def links_from_selected_pages(links: DataFrame, selected: DataFrame) -> DataFrame:
    """Links whose ``pl_from`` is among the ``page_id`` selected."""
    ids = selected.select(F.col("page_id").alias("pl_from"))
    return links.join(ids, "pl_from", "left_semi")


def selected_link_counts(links: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: links kept and skipped by ``links_from_selected_pages``.

    Links are counted per page first, so only one row per page is looked up.
    """
    per_page = links.groupBy("pl_from").agg(F.count("*").alias("n"))
    ids = selected.select(F.col("page_id").alias("pl_from")).distinct()
    known = ids.withColumn("_known", F.lit(True))
    return (
        per_page.join(known, "pl_from", "left")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("n_items"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias(
                "n_skips"
            ),
        )
    )


def sort_links(links: DataFrame) -> DataFrame:
    """All links by page and raw title."""
    return links.orderBy("pl_from", "title")


def collect_page_links(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """``pl_from, part, pl_titles``: the titles of every page as an array.

    Titles are in descending byte order of the raw title, copies kept, and
    only then ``_`` becomes a space. A page with more than ``part_links`` links
    has several parts, in order, so that no row or task holds more; all others
    have part 0 only. Copies are folded into counts before anything is moved,
    and the folded links are stored, as they are read twice.
    """
    folded = store(links.groupBy("pl_from", "title").agg(F.count("*").alias("n")))
    totals = folded.groupBy("pl_from").agg(F.sum("n").alias("_total"))
    wide = totals.where(F.col("_total") > part_links).select("pl_from")
    narrow = folded.join(wide, "pl_from", "left_anti")
    placed = running_total(
        folded.join(wide, "pl_from", "left_semi"),
        [F.col("pl_from"), F.col("title").desc()],
        F.col("n"),
        "_before",
    )
    first = placed.groupBy("pl_from").agg(F.min("_before").alias("_base"))
    # a title's copies may reach over several parts
    start = F.col("_before") - F.col("_base")
    end = start + F.col("n")
    spread = placed.join(first, "pl_from").select(
        "pl_from",
        "title",
        start.alias("_start"),
        end.alias("_end"),
        F.explode(
            F.sequence(F.floor(start / part_links), F.floor((end - 1) / part_links))
        ).alias("part"),
    )
    share = F.least(F.col("_end"), (F.col("part") + 1) * part_links) - F.greatest(
        F.col("_start"), F.col("part") * part_links
    )
    parts = spread.select("pl_from", "part", "title", share.alias("n"))
    return _arrays(narrow.withColumn("part", F.lit(0).cast("bigint")).unionByName(parts))


def _arrays(folded: DataFrame) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("title", "n")), asc=False)
    repeated = F.flatten(
        F.transform(entries, lambda e: F.array_repeat(unslug(e["title"]), e["n"].cast("int")))
    )
    return folded.groupBy("pl_from", "part").agg(repeated.alias("pl_titles"))


def explode_links(pages: DataFrame, key: str = "page_id", links: str = "links") -> DataFrame:
    """``key, pos, link``, with one row of NULLs for a page without links."""
    return pages.select(key, F.posexplode_outer(links).alias("pos", "link"))


def resolve_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """Add ``resolved``: the title that equals ``link`` ignoring case, or NULL.

    Titles that differ by case only give the lowest of them, so links are never
    multiplied. ``titles`` needs ``title``, and may have a ``key`` to match on
    instead of it; further columns of the chosen title are kept.
    """
    key = F.lower("key" if "key" in titles.columns else "title").alias("_key")
    extra = [c for c in titles.columns if c not in ("key", "title")]
    by_key = (
        titles.select(key, F.struct("title", *extra).alias("_title"))
        .groupBy("_key")
        .agg(F.min("_title").alias("_title"))
    )
    return (
        links.withColumn("_key", F.lower("link"))
        .join(by_key, "_key", "left")
        .select(
            *links.columns,
            F.col("_title.title").alias("resolved"),
            *[F.col(f"_title.{c}").alias(c) for c in extra],
        )
    )


def unresolved_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    key = "key" if "key" in titles.columns else "title"
    known = titles.select(F.lower(key).alias("_key"))
    return (
        links.where(F.col("link").isNotNull())
        .withColumn("_key", F.lower("link"))
        .join(known, "_key", "left_anti")
        .drop("_key")
    )


def links_per_page(resolved: DataFrame, key: str = "page_id") -> DataFrame:
    """Links and unresolved links of every page, from ``resolve_links``."""
    is_link = F.col("link").isNotNull()
    return resolved.groupBy(key).agg(
        F.count("link").alias("n_links"),
        F.count_if(is_link & F.col("resolved").isNull()).alias("n_unresolved"),
    )


def link_totals(links: DataFrame, n_pages: DataFrame) -> DataFrame:
    """One row: links of all namespaces, from 0 to any, and 0 to 0, with the averages
    per page. ``n_pages`` holds the pages of namespace 0."""
    pages = n_pages.agg(F.count("*")).scalar()
    from0 = F.col("from_namespace") == 0
    counts = links.agg(
        F.count("*").alias("all_links"),
        F.count_if(from0).alias("ns0_to_all"),
        F.count_if(from0 & (F.col("namespace") == 0)).alias("ns0_to_ns0"),
    ).withColumn("n_pages", pages)
    return counts.withColumn("avg_to_all", F.col("ns0_to_all") / F.col("n_pages")).withColumn(
        "avg_to_ns0", F.col("ns0_to_ns0") / F.col("n_pages")
    )


def limit_links_per_page(
    links: DataFrame,
    n: int,
    src: str = "src",
    order: tuple[str, ...] = ("pos",),
    salts: int = SALTS,
) -> DataFrame:
    """The first ``n`` links of every page, with their ``rank``."""
    return top_per_key(
        links, [src], [F.col(c) for c in order], n, list(order), rank="rank", salts=salts
    )


def trailing_chunk_mean(chunks: DataFrame, size: int = TRAILING_CHUNKS) -> DataFrame:
    """Mean items and skips of the last ``size`` chunks, at every ``size``-th chunk.

    Chunks are numbered from 0. The spans between reports do not overlap, so a
    grouping gives what a trailing window would. An unfinished span is not
    reported.
    """
    span = F.ceil(F.col("chunk") / size) * size
    return (
        chunks.groupBy(span.cast("bigint").alias("at_chunk"))
        .agg(
            F.avg("items").alias("avg_items"),
            F.avg("skips").alias("avg_skips"),
            F.max("chunk").alias("_last"),
        )
        .where(F.col("_last") == F.col("at_chunk"))
        .drop("_last")
    )


def trailing_chunk_means(chunks: DataFrame, size: int = TRAILING_CHUNKS) -> DataFrame:
    """Mean items and skips of every chunk and up to ``size - 1`` before it, at every chunk.

    ``chunks`` has chunk, items and skips, whole numbers; chunk orders the rows
    and need not be dense, but tells them apart. NULL items or skips do not
    count, as in a mean over a window. A chunk's frame is the difference of two
    running totals, its own and that of the chunk ``size`` places before, which
    is joined by place: no task sees all chunks in a row.
    """
    values = ("items", "skips")
    held = {f"_{v}": F.coalesce(F.col(v), F.lit(0)) for v in values}
    given = {f"_{v}_n": F.col(v).isNotNull().cast("int") for v in values}
    totals = running_totals(chunks.select("chunk", *values), [F.col("chunk")], {"_at": F.lit(1)} | held | given)
    totals = store(totals)
    upto = {c: F.col(c) + own for c, own in (held | given).items()}
    now = totals.select("chunk", "_at", *[x.alias(c) for c, x in upto.items()])
    # the running total before a frame's first row
    before = totals.select((F.col("_at") + size - 1).alias("_at"), *[F.col(c).alias(f"{c}_before") for c in upto])
    both = now.join(before, "_at", "left")
    inside = {c: F.col(c) - F.coalesce(f"{c}_before", F.lit(0)) for c in upto}
    return both.select(
        F.col("chunk").alias("at_chunk"),
        *[(inside[f"_{v}"] / F.nullif(inside[f"_{v}_n"], F.lit(0))).alias(f"avg_{v}") for v in values],
    )


def title_ids(links: DataFrame, title: str = "title", seen: str | None = None) -> DataFrame:
    """``title, title_id``: a dense number from 0 for every title.

    Numbered by title, or by first appearance with ``seen``, a column that
    orders the links. Numbers are given per range of titles, not by one task.
    """
    first = F.min(seen) if seen else F.lit(0)
    distinct = links.groupBy(F.col(title).alias("title")).agg(first.alias("_first"))
    return global_index(distinct, [F.col("_first"), F.col("title")], "title_id").drop("_first")


def replace_titles(links: DataFrame, ids: DataFrame, title: str = "title") -> DataFrame:
    """Links with the title's number in place of the title."""
    return links.join(ids.withColumnRenamed("title", title), title).drop(title)
