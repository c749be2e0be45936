"""Forms for large tables beside the plain ones: sketches, trailing frames, versions, pruned reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import STEM, write_dump, xml_page

from dumpweave.operators import links, stats
from dumpweave.plans.ordered import running_totals
from dumpweave.sinks import tables as sinks
from dumpweave.sources import xml_dump


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_trailing_means(spark, size):
    rng = np.random.default_rng(2)
    rows = [(int(3 * i + i % 2), None if i % 11 == 5 else int(rng.integers(0, 99)), int(i)) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk long, items long, skips long").repartition(7)
    found = {r.at_chunk: (r.avg_items, r.avg_skips) for r in links.trailing_chunk_means(chunks, size).collect()}
    assert len(found) == len(rows)
    for i, (chunk, _, _) in enumerate(rows):
        frame = rows[max(0, i - size + 1) : i + 1]
        for k in (1, 2):
            given = [r[k] for r in frame if r[k] is not None]
            want = sum(given) / len(given) if given else None
            assert found[chunk][k - 1] == pytest.approx(want) if given else found[chunk][k - 1] is None
    assert links.trailing_chunk_means(chunks.limit(0), size).count() == 0


def test_no_task_sees_all_chunks_in_a_row(spark):
    chunks = spark.range(100).select(F.col("id").alias("chunk"), F.col("id").alias("items"), F.col("id").alias("skips"))
    plan = links.trailing_chunk_means(chunks, 7)._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]  # windows are over ranges, before the stage table


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i % 5, None if i % 3 else i) for i in range(50)], "k int, a int, b int").repartition(4)
    got = {r.k: (r.sa, r.sb) for r in running_totals(df, [F.col("k")], {"sa": F.col("a"), "sb": F.coalesce("b", F.lit(0))}).collect()}
    assert got == {i: (sum(j % 5 for j in range(i)), sum(j for j in range(i) if not j % 3)) for i in range(50)}


@pytest.mark.parametrize("kind", ["uniform", "skewed", "equal"])
def test_sketches_merge_within_their_error(spark, kind):
    rng = np.random.default_rng(6)
    values = {
        "uniform": rng.integers(0, 100_000, 30_000), "skewed": (rng.pareto(1.0, 30_000) * 100).astype(int), "equal": np.full(3_000, 7),
    }[kind]
    rows = [(int(i % 13), int(v)) for i, v in enumerate(values)] + [(1, None)]
    df = spark.createDataFrame(rows, "file int, length long").repartition(9)
    parts = stats.length_sketches(df, ["file"])
    assert parts.agg(F.sum("n")).first()[0] == len(values) and parts.count() == 13
    found = stats.sketched_percentiles(stats.merge_sketches(parts)).collect()
    assert [r.share for r in found] == stats.PERCENTILES
    for r in found:
        below, upto = (values < r.value).mean(), (values <= r.value).mean()
        assert below - stats.SKETCH_ERROR <= r.share <= upto + stats.SKETCH_ERROR
    by_file = stats.sketched_percentiles(parts)
    assert by_file.count() == 13 * len(stats.PERCENTILES) and set(by_file.columns) == {"file", "n", "share", "value"}
    assert stats.sketched_percentiles(stats.length_sketches(df.limit(0), ["file"])).count() == 0


def page(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "page_id long, page_title string")


def ids(df):
    return sorted(r[0] for r in df.select("page_id").collect())


def test_rebuild_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, root)
    text = spark.createDataFrame([("a", ["h"], ["s"], ["l"])], sinks.SCHEMAS["text"])
    assert sinks.rebuild_version(spark, {"page": page(spark, 1, 2), "talk": page(spark, 9), "text": text}, root) == 1
    pinned = sinks.read_version(spark, root)

    # a rebuild that stops between two tables
    conform, written = sinks.conform, []

    def stopping(df, name):
        if name == "talk":
            raise RuntimeError("stopped")
        written.append(name)
        return conform(df, name)

    monkeypatch.setattr(sinks, "conform", stopping)
    with pytest.raises(RuntimeError):
        sinks.rebuild_version(spark, {"page": page(spark, 3)}, root)
    assert written == ["page", "link"]
    monkeypatch.setattr(sinks, "conform", conform)
    assert sinks.versions(spark, root) == [1]
    assert ids(sinks.read_version(spark, root)["page"]) == [1, 2]

    assert sinks.rebuild_version(spark, {"page": page(spark, 4)}, root) == 2
    now = sinks.read_version(spark, root)
    assert ids(now["page"]) == [4] and ids(now["talk"]) == [] and now["text"].count() == 1 and now["quality"].count() == 0
    # readers of the set before still read it
    assert ids(pinned["page"]) == [1, 2] and ids(pinned["talk"]) == [9]
    assert ids(sinks.read_version(spark, root, 1)["talk"]) == [9]


def test_of_two_rebuilds_that_end_at_once_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    sinks.rebuild_version(spark, {"page": page(spark, 1)}, root)
    monkeypatch.setattr(sinks, "versions", lambda spark, root: [])  # both saw the same state
    with pytest.raises(FileExistsError):
        sinks.rebuild_version(spark, {"page": page(spark, 2)}, root)
    monkeypatch.undo()
    assert ids(sinks.read_version(spark, root)["page"]) == [1]


def test_only_files_that_may_hold_the_ids_are_opened(spark, tmp_path):
    for first in (1, 6, 11):
        write_dump(tmp_path / f"{STEM}{first}.xml-p{first}p{first + 4}.bz2", [xml_page(f"T{i}", "x", page_id=i) for i in range(first, first + 5)])
    # a file outside the range that would fail
    (tmp_path / f"{STEM}9.xml-p100p200.bz2").write_bytes(b"no bz2 at all")
    found = xml_dump.read_xml_pages_between(spark, str(tmp_path), 4, 7)
    assert sorted(r.id for r in found.collect()) == [4, 5, 6, 7]
    assert sorted(name.split("xml-")[1] for name in found.inputFiles()) == ["p1p5.bz2", "p6p10.bz2"]
    assert xml_dump.read_xml_pages_between(spark, str(tmp_path), 300, 400).count() == 0
