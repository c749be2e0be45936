import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpweave.operators import checks, links, pages, quality
from dumpweave.plans.ordered import global_index, running_total
from dumpweave.plans.skew import mark_first, top_per_key
from dumpweave.sinks.tables import expected_count_gate, rebuild_tables, write_table, write_tables
from dumpweave.sources.tables import read_table, read_tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- plans: equal to brute force, with a hot key -----------------------------------
def hot_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.randrange(1000)) for i in range(n)]


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_mark_first(spark, salts):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, i int, v int")
    marked = mark_first(df, ["k"], [F.col("v").desc(), F.col("i")], ["i"], salts=salts)
    first = {}
    for k, i, v in sorted(data, key=lambda r: (-r[2], r[1])):
        first.setdefault(k, i)
    assert marked.count() == len(data)
    assert {r.k: r.i for r in marked.where("is_first").collect()} == first


@pytest.mark.parametrize("k", [1, 5, 150])
def test_top_per_key(spark, k):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, i int, v int")
    top = top_per_key(df, ["k"], [F.col("v"), F.col("i")], k, ["i"], salts=4)
    want = []
    for key in {r[0] for r in data}:
        ranked = sorted((r for r in data if r[0] == key), key=lambda r: (r[2], r[1]))
        want += [(*r, n + 1) for n, r in enumerate(ranked[:k])]
    assert rows(top) == sorted(want, key=repr)


def test_running_total(spark):
    rng = random.Random(2)
    data = list({(rng.randrange(50), rng.randrange(10_000)): None for _ in range(3000)})
    weighted = [(a, b, rng.randrange(5)) for a, b in data]
    df = spark.createDataFrame(weighted, "a int, b int, w int").repartition(8)
    found = running_total(df, [F.col("a"), F.col("b").desc()], F.col("w"), "before")
    total, want = 0, []
    for a, b, w in sorted(weighted, key=lambda r: (r[0], -r[1])):
        want.append((a, b, w, total))
        total += w
    assert rows(found) == sorted(want, key=repr)
    index = global_index(df, [F.col("a"), F.col("b")]).orderBy("a", "b").collect()
    assert [r["index"] for r in index] == list(range(len(data)))


# --- pages ---------------------------------------------------------------------------
def test_dedupe(spark):
    data = [(1, 0, 0, "T"), (1, 0, 1, "T"), (1, 1, 0, "T"), (2, 0, 0, "U"), (2, 0, 1, "V")]
    df = spark.createDataFrame(data, "file_start long, chunk long, pos long, title string")
    found = {tuple(r)[:3]: r.status for r in pages.dedupe_by_title(df).collect()}
    assert [k for k, s in found.items() if s == "added" and k[0] == 1] == [(1, 0, 1)]
    existing = spark.createDataFrame([("U",), ("U",), ("Z",)], "title string")
    loaded = pages.dedupe_by_title(df, existing)
    assert loaded.count() == 5
    assert {r.title for r in loaded.where("status = 'added'").collect()} == {"T", "V"}
    report = rows(pages.load_report(loaded, ["file_start"]))
    assert report == [(1, 3, 1, 2, 0), (2, 2, 1, 1, 0)]
    assert rows(pages.load_totals(loaded)) == [("added", 2), ("duplicate", 3)]
    assert pages.duplicate_log(loaded).columns == df.columns
    first = pages.limit_per_file(df.where("chunk = 0"), 1)
    assert rows(first) == [(1, 0, 0, "T"), (2, 0, 0, "U")]


def test_longest_title(spark):
    data = [(1, 0, "ab"), (1, 1, "cde"), (1, 2, "fgh"), (2, 0, "xyz"), (2, 1, None)]
    df = spark.createDataFrame(data, "file_start long, pos long, title string")
    assert rows(pages.article_count_longest_title(df)) == [(1, 3, "cde"), (2, 2, "xyz")]
    assert rows(pages.article_count_longest_title(df, per_file=False)) == [(5, "cde")]
    empty = pages.article_count_longest_title(df.limit(0), per_file=False)
    assert rows(empty) == [(0, None)]


def test_valid_page(spark):
    ok = ["a", "b"]
    data = [
        ("good", ok, ok, ok),
        (None, ok, ok, ok),
        ("h", None, ok, ok),
        ("he", ["a", None], ok, ok),
        ("s", ok, None, ok),
        ("l", ok, ok, None),
        ("le", ok, ok, [None]),
        ("size", ok, ["a"], ok),
    ]
    schema = "title string, headings array<string>, sections array<string>, links array<string>"
    found = {r.title: r.reason for r in pages.valid_page(spark.createDataFrame(data, schema)).collect()}
    assert found == {
        "good": None, None: "invalid title", "h": "invalid headings",
        "he": "invalid headings element", "s": "invalid sections", "l": "invalid links",
        "le": "invalid links element", "size": "sizes differ",
    }


def test_page_diff(spark):
    schema = "title string, headings array<string>, links array<string>"
    old = spark.createDataFrame([("a", ["x"], None), ("b", ["x"], []), ("c", [], [])], schema)
    new = spark.createDataFrame([("a", ["x"], None), ("b", ["y"], []), ("d", [], [])], schema)
    assert rows(pages.page_diff(old, new)) == [
        ("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added"),
    ]


def test_lookups_and_paging(spark):
    df = spark.createDataFrame([(3, "Quantum"), (1, "QUANTUM"), (2, "dog")], "id int, title string")
    assert rows(pages.find_by_title(df, "quaNtum")) == [(1, "QUANTUM"), (3, "Quantum")]
    assert rows(pages.find_exact(df, ["id"], title="dog")) == [(2, "dog")]
    assert rows(pages.page_of_rows(df, ["id"], 1, 1)) == [(2, "dog")]
    assert rows(pages.page_after(df, "id", 1, 1)) == [(2, "dog")]
    assert pages.combine_chunks(df, df, df).count() == 9


# --- quality ----------------------------------------------------------------------------
def test_qualities(spark):
    data = [(1, 7, "B-Class_x"), (2, 7, "FA-Class_x"), (3, 8, "GA-Class_y"), (4, 9, "Stubs")]
    df = spark.createDataFrame(data, "seq long, id long, category string")
    graded = quality.quality_from_category(df)
    first = {r.id: r.quality for r in quality.first_quality_per_page(graded).collect()}
    best = {r.id: r.quality for r in quality.first_quality_per_page(graded, "best").collect()}
    assert first == {7: "B", 8: "GA"} and best == {7: "FA", 8: "GA"}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "page": spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "page_id long, page_title string"),
        "talk": spark.createDataFrame([(11, "A"), (12, "B")], "page_id long, page_title string"),
        "quality": spark.createDataFrame([(11, "FA"), (19, "C")], "page_id long, page_quality string"),
        "link": spark.createDataFrame(
            [(1, 0, ["B", "C"]), (2, 0, ["A"])], "pl_from long, part long, pl_titles array<string>"
        ),
        "text": spark.createDataFrame(
            [("A", ["Lead"], ["x"], ["B"])],
            "title string, headings array<string>, sections array<string>, links array<string>",
        ),
    }


def test_quality_joins(spark, tables):
    page, talk, graded = tables["page"], tables["talk"], tables["quality"]
    assert rows(quality.page_quality(page, talk, graded)) == [(1, "A", 11, "FA")]
    one_page = quality.page_links_quality(tables["link"], page, talk, graded).where("pl_from = 1")
    assert rows(one_page) == [(1, "A", "FA", 0, ["B", "C"])]
    assert rows(quality.quality_walk(graded, talk, page)) == [(11, "FA", "A", 1), (19, "C", None, None)]
    kept, skipped = quality.quality_of_existing_talk(graded, talk)
    assert rows(kept) == [(11, "FA")] and rows(skipped) == [(19, "C")]
    candidates = spark.createDataFrame(
        [(13, "C"), (14, "Orphan"), (15, "y" * 201)], "page_id long, page_title string"
    )
    status = {r.page_id: r.status for r in quality.talk_of_existing_pages(candidates, page).collect()}
    assert status == {13: "kept", 14: "skipped_no_page", 15: "skipped_length"}


def test_tables_round_trip(spark, tables, tmp_path):
    root = str(tmp_path)
    write_tables(tables, root)
    for name, df in read_tables(spark, root).items():
        assert rows(df) == rows(tables[name])
    rebuild_tables(spark, {"page": tables["page"].limit(1)}, root)
    counts = {name: df.count() for name, df in read_tables(spark, root).items()}
    assert counts == {"text": 1, "page": 1, "talk": 0, "link": 0, "quality": 0}
    write_table(tables["page"], root, "page", mode="append")
    assert read_table(spark, root, "page").count() == 4
    assert rows(expected_count_gate(tables["page"], 3)) == [(3, 3, True)]


def test_integrity(spark, tables):
    report = {(r.table_name, r.check_name): r.violations for r in checks.integrity_report(tables).collect()}
    assert report["quality", "page_id in talk"] == 1
    assert sum(report.values()) == 1
    broken = dict(tables)
    broken["page"] = tables["page"].unionByName(
        spark.createDataFrame([(1, "y" * 201), (None, "A")], "page_id long, page_title string")
    )
    report = {(r.table_name, r.check_name): r.violations for r in checks.integrity_report(broken).collect()}
    assert report["page", "unique page_id"] == 1 and report["page", "unique page_title"] == 1
    assert report["page", "length page_title"] == 1 and report["page", "not null page_id"] == 1


def test_collisions(spark):
    df = spark.createDataFrame([("für",), ("fur",), ("fur",), ("漢",), ("字",), ("ok",)], "title string")
    assert rows(checks.translit_collisions(df)) == sorted(
        [("", 2, "字", "漢"), ("fur", 2, "fur", "für")], key=repr
    )
    assert checks.colliding_titles(df).count() == 4


# --- links -----------------------------------------------------------------------------------
def test_link_order(spark):
    data = [(1, "a_b"), (1, "aZ"), (1, "aa"), (2, "x")]
    df = spark.createDataFrame(data, "pl_from long, title string")
    found = {r.pl_from: (r.part, r.pl_titles) for r in links.collect_page_links(df).collect()}
    assert found == {1: (0, ["aa", "a b", "aZ"]), 2: (0, ["x"])}


def test_link_arrays_of_ids(spark):
    pairs = [(1, "5"), (2, "1"), (1, "4"), (0, "3"), (0, "2")]
    df = spark.createDataFrame(pairs, "pl_from long, title string")
    found = {r.pl_from: r.pl_titles for r in links.collect_page_links(df).collect()}
    assert found == {2: ["1"], 1: ["5", "4"], 0: ["3", "2"]}


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.text("abZ_", min_size=1, max_size=2)), min_size=1, max_size=60),
    st.integers(1, 9),
)
def test_wide_pages_have_parts(spark, data, part_links):
    df = spark.createDataFrame(data, "pl_from long, title string")
    parts = links.collect_page_links(df, part_links).orderBy("pl_from", "part").collect()
    want = {}
    for page, title in sorted(data, reverse=True):
        want.setdefault(page, []).append(title.replace("_", " "))
    got = {}
    for r in parts:
        assert len(r.pl_titles) <= part_links and r.part * part_links == len(got.get(r.pl_from, []))
        got.setdefault(r.pl_from, []).extend(r.pl_titles)
    assert got == want


def test_resolving(spark):
    arrays = spark.createDataFrame(
        [(1, ["DOG", "cat", "dog", "none"]), (2, []), (3, None)], "page_id long, links array<string>"
    )
    titles = spark.createDataFrame([("Dog",), ("dog",), ("Cat",)], "title string")
    resolved = links.resolve_links(links.explode_links(arrays), titles)
    first = resolved.where("page_id = 1").orderBy("pos").collect()
    assert [r.resolved for r in first] == ["Dog", "Cat", "Dog", None]
    assert rows(links.links_per_page(resolved)) == [(1, 4, 1), (2, 0, 0), (3, 0, 0)]
    left = links.unresolved_links(links.explode_links(arrays), titles)
    assert rows(left) == [(1, 3, "none")]


def test_totals_and_selection(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", 0), (1, 1, "b", 0), (2, 0, "c", 1), (3, 0, "d", 0)],
        "pl_from long, namespace long, title string, from_namespace long",
    )
    page = spark.createDataFrame([(1,), (2,)], "page_id long")
    assert rows(links.link_totals(df, page)) == [(4, 3, 2, 2, 1.5, 1.0)]
    ns0 = links.ns0_links(df)
    assert rows(links.links_from_selected_pages(ns0, page)) == [(1, "a")]
    assert rows(links.selected_link_counts(ns0, page)) == [(1, 1)]
    assert rows(links.selected_link_counts(ns0.limit(0), page)) == [(0, 0)]


def test_trailing_mean(spark):
    items = [(i, (i * 7) % 11, i % 3) for i in range(25)]
    df = spark.createDataFrame(items, "chunk long, items long, skips long")
    found = {r.at_chunk: (r.avg_items, r.avg_skips) for r in links.trailing_chunk_mean(df, 10).collect()}
    assert sorted(found) == [0, 10, 20]
    for at in found:
        last = items[: at + 1][-10:]
        assert found[at] == pytest.approx(
            (sum(x[1] for x in last) / len(last), sum(x[2] for x in last) / len(last))
        )


def test_title_ids(spark):
    df = spark.createDataFrame([(5, "b"), (6, "a"), (7, "b"), (8, "c")], "n long, title string")
    assert rows(links.title_ids(df)) == [("a", 0), ("b", 1), ("c", 2)]
    seen = links.title_ids(df, seen="n")
    assert rows(seen) == [("a", 1), ("b", 0), ("c", 2)]
    assert rows(links.replace_titles(df, seen)) == [(5, 0), (6, 1), (7, 0), (8, 2)]
