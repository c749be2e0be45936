"""Graphs of the pages within some links of a start page."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.operators.links import limit_links_per_page
from dumpweave.plans.session import cut_lineage, store, work_dir

#: Links of a bucket of a stored graph.
BUCKET_LINKS = 4_000_000


def stored_links(links: DataFrame, buckets: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """``links`` (src, dst and others) as a table in buckets of ``src``, sorted within.

    A level of a graph then joins the links where they lie: only its frontier
    is moved, and a cap's ranks need no exchange either. Build it once for all
    graphs. The table goes with the stage tables; its name is of this session.
    """
    spark = links.sparkSession
    if buckets is None:
        links = store(links)
        buckets = max(links.count() // BUCKET_LINKS + 1, spark.sparkContext.defaultParallelism)
    name = f"links_{uuid.uuid4().hex}"
    writer = links.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src", *order)
    writer.option("path", work_dir(spark, "links")).saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    with suppress(Exception):  # the session may be gone by then
        spark.sql(f"drop table if exists {name}")


def level_graph(
    links: DataFrame,
    start: str,
    levels: int = 1,
    cap: int | None = None,
    pages: DataFrame | None = None,
    order: tuple[str, ...] = ("pos",),
) -> tuple[DataFrame, DataFrame]:
    """(vertices ``id, level, is_mapped``, edges ``src, dst, rank, level``).

    ``links`` has ``src, dst`` and the ``order`` columns. All links count; with a
    ``cap`` the first ones of every page do, whether or not they lead to
    something new. ``rank`` is a link's place among those of its page, NULL
    without a cap. ``pages``
    (``id``) tells which pages exist, by default those with links. A page that
    does not exist stays in as an unmapped vertex; a start page that does not
    exist gives an empty graph. The last level is not mapped.

    Each level is one join of the links with the frontier, the vertices found
    last; the links it follows are checkpointed, and the frontier is stored, so
    that its measured size decides how it is joined. With ``stored_links`` no
    level moves the links. Nothing is collected, and the loop ends when nothing
    new is found.
    """
    root = links.sparkSession.range(1).select(F.lit(start).alias("id"))
    frontier = reached = root
    found = root.withColumn("level", F.lit(0).cast("bigint"))
    mapped_parts, edge_parts = [], []
    for level in range(levels):
        nearby = links.join(frontier.withColumnRenamed("id", "src"), "src")
        out = _first_links(nearby, cap, order).select("src", "dst", "rank")
        out = cut_lineage(out.withColumn("level", F.lit(level).cast("bigint")))
        edge_parts.append(out)
        if pages is None:
            mapped_parts.append(out.select(F.col("src").alias("id")).distinct())
        else:
            exist = pages.select("id").join(frontier, "id", "left_semi").distinct()
            mapped_parts.append(cut_lineage(exist))
        if level == 0 and mapped_parts[0].isEmpty():
            found = found.limit(0)
            break
        ends = out.select(F.col("dst").alias("id"))
        found = found.unionByName(ends.withColumn("level", F.lit(level + 1).cast("bigint")))
        frontier = store(ends.distinct().join(reached, "id", "left_anti"))
        reached = reached.unionByName(ends)
        if frontier.isEmpty():
            break
    mapped = reduce(DataFrame.unionByName, mapped_parts).withColumn("_mapped", F.lit(True))
    first = found.groupBy("id").agg(F.min("level").alias("level"))
    vertices = first.join(mapped, "id", "left").select(
        "id", "level", F.col("_mapped").isNotNull().alias("is_mapped")
    )
    return vertices, reduce(DataFrame.unionByName, edge_parts)


def _first_links(links: DataFrame, cap: int | None, order: tuple[str, ...]) -> DataFrame:
    if cap is None:
        return links.withColumn("rank", F.lit(None).cast("int"))
    return limit_links_per_page(links, cap, order=order)


def graph_edges(
    links: DataFrame, vertices: DataFrame, cap: int | None = None, order=("pos",)
) -> DataFrame:
    """One edge per link of every mapped vertex, with a ``cap`` per first link; self,
    parallel and opposite edges are all kept."""
    mapped = vertices.where(F.col("is_mapped")).select(F.col("id").alias("src"))
    return _first_links(links.join(mapped, "src", "left_semi"), cap, order).select("src", "dst")


def vertex_status(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """``id, in_graph, is_mapped`` for the ``id`` asked about."""
    return names.join(vertices, "id", "left").select(
        "id",
        F.col("level").isNotNull().alias("in_graph"),
        F.coalesce("is_mapped", F.lit(False)).alias("is_mapped"),
    )


def unmapped_vertices(vertices: DataFrame) -> DataFrame:
    return vertices.where(~F.col("is_mapped"))


def level_filter(vertices: DataFrame, level: int) -> DataFrame:
    return vertices.where(F.col("level") <= level)


def graph_from_pairs(
    pairs: DataFrame, attributes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) from ``src, dst``; ``attributes`` (``id, ...``) are added to
    the vertices, NULL where there is none."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    vertices = ends if attributes is None else ends.join(attributes, "id", "left")
    return vertices, pairs.select("src", "dst")


def graph_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of vertices and of edges."""
    n_edges = edges.agg(F.count("*")).scalar()
    return vertices.agg(F.count("*").alias("n_vertices")).withColumn("n_edges", n_edges)


def _nodes(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", F.col("level").alias("group"))


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).alias("value")
    )


def graph_records(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, json``: every node and link as one JSON object."""
    nodes, links = _nodes(vertices), _links(edges)
    return nodes.select(
        F.lit("nodes").alias("part"), F.to_json(F.struct("*")).alias("json")
    ).unionByName(
        links.select(F.lit("links").alias("part"), F.to_json(F.struct("*")).alias("json"))
    )


def graph_name(start: str, levels: int, cap: int) -> str:
    return f"{start.replace(' ', '_')}_l_{levels}_ppl_{cap}.json"


def write_graph(vertices: DataFrame, edges: DataFrame, folder: str, name: str) -> str:
    """Write ``nodes`` and ``links`` as JSON lines below ``folder/name``."""
    target = f"{folder.rstrip('/')}/{name}"
    _nodes(vertices).write.mode("overwrite").json(f"{target}/nodes")
    _links(edges).write.mode("overwrite").json(f"{target}/links")
    return target
