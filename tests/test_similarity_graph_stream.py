import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dumpweave.operators import graph, similarity
from dumpweave.operators.pages import dedupe_by_title
from dumpweave.plans.session import cut_lineage, shared_dir, stages, store
from dumpweave.streaming.incremental import incremental_load, load_log

CORPUS = {
    1: "The quick brown fox jumps over the lazy dog",
    2: "A lazy dog sleeps; the dog dreams of a quick fox.",
    3: "Stars and galaxies drift apart",
    4: "",
    5: "the the the fox",
}


def brute_force(corpus):
    counts = {d: Counter(re.findall(r"\w\w+", t.lower())) for d, t in corpus.items()}
    df = Counter(term for c in counts.values() for term in c)
    out = {}
    for d, c in counts.items():
        raw = {t: n * (math.log((1 + len(corpus)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[d] = {t: x / norm for t, x in raw.items()}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    docs = spark.createDataFrame(list(CORPUS.items()), "doc long, text string")
    return cut_lineage(similarity.tfidf(docs))


def test_tfidf(vectors):
    want = brute_force(CORPUS)
    got = {(r.doc, r.term): r.weight for r in vectors.collect()}
    assert got == pytest.approx({(d, t): w for d, v in want.items() for t, w in v.items()})


def test_cosine(spark, vectors):
    want = brute_force(CORPUS)
    asked = [(a, b) for a in CORPUS for b in CORPUS if a < b] + [(1, 99)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    got = {(r.a, r.b): r.similarity for r in similarity.pairwise_cosine(vectors, pairs).collect()}
    assert len(got) == len(asked)
    for a, b in asked:
        expected = sum(w * want.get(b, {}).get(t, 0) for t, w in want[a].items())
        assert got[a, b] == pytest.approx(expected)


def test_similar_pages(spark, vectors):
    links = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 5), (1, 1), (3, 4)], "src long, dst long")
    found = similarity.similar_pages(links, vectors, threshold=0.01)
    assert {(r.src, r.dst) for r in found.collect()} == {(1, 2), (1, 5)}
    best = similarity.similar_pages(links, vectors, threshold=0.01, k=1).collect()
    assert len(best) == 1 and best[0].src == 1
    assert similarity.similar_pages(links, vectors).count() == 4


def test_terms(spark, vectors):
    top = similarity.top_terms(vectors, 1).where("doc = 5").first()
    assert (top.term, top.rank) == ("the", 1)
    ordered = [(r.doc, -r.weight) for r in similarity.sort_terms(vectors).collect()]
    assert ordered == sorted(ordered)
    wide = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.0, 1.0)], "doc long, a double, b double")
    melted = similarity.melt_terms(wide, ["a", "b"])
    assert {tuple(r) for r in melted.collect()} == {(1, "a", 0.5), (2, "b", 1.0)}


def test_normalised_corpus(spark):
    docs = spark.createDataFrame(list(CORPUS.items()), "doc long, text string")
    terms = {r.term for r in similarity.tfidf(similarity.normalised_corpus(docs)).collect()}
    assert "the" not in terms and "fox" in terms


# --- graph -----------------------------------------------------------------------------
LINKS = [
    ("S", 0, "A"), ("S", 1, "B"), ("S", 2, "C"),
    ("A", 0, "S"), ("A", 1, "B"), ("A", 2, "D"),
    ("B", 0, "B"),
]


def level_graph(spark, levels, cap, start="S", **options):
    links = spark.createDataFrame(LINKS, "src string, pos int, dst string")
    vertices, edges = graph.level_graph(links, start, levels, cap, **options)
    found = {r.id: (r.level, r.is_mapped) for r in vertices.collect()}
    return found, sorted((r.src, r.dst) for r in edges.collect()), vertices, edges, links


def test_level_graph(spark):
    found, edges, vertices, _, links = level_graph(spark, 2, 2)
    assert found == {"S": (0, True), "A": (1, True), "B": (1, True)}
    assert edges == [("A", "B"), ("A", "S"), ("B", "B"), ("S", "A"), ("S", "B")]
    again = graph.graph_edges(links, vertices, 2)
    assert sorted(tuple(r) for r in again.collect()) == edges


def test_level_graph_unmapped(spark):
    found, edges, vertices, edge_rows, _ = level_graph(spark, 1, 2)
    assert found == {"S": (0, True), "A": (1, False), "B": (1, False)}
    assert edges == [("S", "A"), ("S", "B")]
    found, edges, vertices, edge_rows, _ = level_graph(spark, 2, 3)
    assert found["C"] == (1, False) and found["D"] == (2, False)
    assert {r.id for r in graph.unmapped_vertices(vertices).collect()} == {"C", "D"}
    assert {r.id for r in graph.level_filter(vertices, 0).collect()} == {"S"}
    summary = graph.graph_summary(vertices, edge_rows).first()
    assert tuple(summary) == (5, 7)
    names = spark.createDataFrame([("S",), ("C",), ("nowhere",)], "id string")
    status = {r.id: (r.in_graph, r.is_mapped) for r in graph.vertex_status(vertices, names).collect()}
    assert status == {"S": (True, True), "C": (True, False), "nowhere": (False, False)}


def test_level_graph_ends(spark):
    assert level_graph(spark, 2, 2, start="nowhere")[:2] == ({}, [])
    deep = level_graph(spark, 9, 3)  # nothing new after a while
    assert set(deep[0]) == {"S", "A", "B", "C", "D"}
    pages = spark.createDataFrame([("S",), ("C",)], "id string")
    found = level_graph(spark, 2, 3, pages=pages)[0]
    assert found["C"] == (1, True)


def test_level_graph_without_cap(spark):
    found = level_graph(spark, 2, None)[0]
    assert set(found) >= set(level_graph(spark, 2, 2)[0])


def test_graph_files(spark, tmp_path):
    _, edges, vertices, edge_rows, _ = level_graph(spark, 2, 2)
    name = graph.graph_name("University of X", 2, 10)
    assert name == "University_of_X_l_2_ppl_10.json"
    target = graph.write_graph(vertices, edge_rows, str(tmp_path), name)
    assert spark.read.json(f"{target}/nodes").count() == 3
    stored = spark.read.json(f"{target}/links").collect()
    assert sorted((r.source, r.target) for r in stored) == edges and stored[0].value == 1



def test_graph_from_pairs(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 1)], "src long, dst long")
    people = spark.createDataFrame([(0, "Ann", 30), (1, "Bo", 4)], "id long, name string, age int")
    vertices, edges = graph.graph_from_pairs(pairs, people)
    assert {tuple(r) for r in vertices.collect()} == {(0, "Ann", 30), (1, "Bo", 4), (2, None, None)}
    assert edges.count() == 3


# --- stream -----------------------------------------------------------------------------
def test_incremental_load(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "file_start long, chunk long, pos long, title string"
    first = spark.createDataFrame([(1, 0, 0, "T"), (1, 0, 1, "T"), (1, 1, 0, "U")], schema)
    second = spark.createDataFrame([(0, 0, 0, "T"), (2, 0, 1, "V"), (2, 0, 2, "V")], schema)
    for delivery in (first, second):
        delivery.coalesce(1).write.mode("append").parquet(source)
        incremental_load(spark, source, first.schema, target, log)
    got = load_log(spark, target, first.schema)
    added = {(r.title, r.file_start, r.pos, r.batch_id) for r in got.where("status = 'added'").collect()}
    assert added == {("T", 1, 1, 0), ("U", 1, 0, 0), ("V", 2, 2, 1)}
    assert got.count() == 6
    incremental_load(spark, source, first.schema, target, log)  # nothing new
    assert load_log(spark, target, first.schema).count() == 6


def test_one_batch_equals_batch_dedupe(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    pages = spark.range(300).select(
        (F.col("id") % 7).alias("file_start"),
        F.floor(F.col("id") / 20).alias("chunk"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5((F.col("id") % 90).cast("string"))).alias("title"),
    )
    pages.write.parquet(source)
    incremental_load(spark, source, pages.schema, target, log)
    got = load_log(spark, target, pages.schema).drop("stream", "batch_id")
    want = dedupe_by_title(pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shared_folder_is_the_one_named(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


class _Session:
    """Just what ``shared_dir`` asks of a session that names no folder for checkpoints."""

    def __init__(self):
        self.folder = None
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return {"spark.sql.warehouse.dir": "hdfs://host/warehouse"}.get(key, default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_when_none_is_named():
    session = _Session()
    first = shared_dir(session)
    assert first == "hdfs://host/warehouse/_stages"
    assert shared_dir(session) == first == session.folder


def test_stage_tables_go_with_their_scope(spark):
    with stages(spark):
        kept = store(spark.range(3))
        folder = kept.stage_path
        assert kept.count() == 3 and os.path.exists(folder)
    assert not os.path.exists(folder)


def test_a_new_checkpoint_keeps_what_others_loaded(spark, tmp_path):
    schema = "file_start long, chunk long, pos long, title string"
    target = str(tmp_path / "target")
    for i, titles in enumerate((["T"], ["U", "T"], ["V", "U", "K"])):
        source = str(tmp_path / f"source{i}")
        made = spark.createDataFrame([(i, 0, j, t) for j, t in enumerate(titles)], schema)
        made.write.parquet(source)
        known = spark.createDataFrame([("K",)], "title string") if i == 2 else None
        incremental_load(spark, source, made.schema, target, str(tmp_path / f"log{i}"), existing=known)
    got = load_log(spark, target, made.schema)
    assert sorted((r.title, r.status) for r in got.collect()) == [
        ("K", "duplicate"), ("T", "added"), ("T", "duplicate"), ("U", "added"), ("U", "duplicate"), ("V", "added"),
    ]


def test_cosine_of_a_repeated_pair(spark):
    vectors = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "doc long, term string, weight double")
    pairs = spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")
    assert [tuple(r) for r in similarity.pairwise_cosine(vectors, pairs).collect()] == [(1, 2, 1.0)]


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.8, 1.0 - 1e-6])
def test_similar_pairs_are_all_pairs_above_the_threshold(spark, threshold):
    rng = np.random.default_rng(4)
    common = [f"often{i}" for i in range(3)]
    rows = []
    for doc in range(120):
        near = rng.integers(0, 12)
        words = [f"w{near}_{i}" for i in rng.integers(0, 9, 8)] + [f"w{i}" for i in rng.integers(0, 400, 4)]
        rows.append((doc, " ".join(common + words)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, rows[0][1] + " " + rows[0][1]), (203, ""), (204, None), (205, "alone")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    vectors = cut_lineage(similarity.tfidf(docs))
    pairs, classes = similarity.similar_pairs(vectors, threshold)
    told = {r.doc: r.representative for r in classes.collect()}
    assert told == {d: 0 if d in (0, 200, 201) else d for d, text in rows if text}
    held = {}
    for r in vectors.collect():
        held.setdefault(r.doc, {})[r.term] = r.weight
    chosen = sorted(set(told.values()))
    want = {}
    for i, a in enumerate(chosen):
        for b in chosen[i + 1 :]:
            value = sum(w * held[b].get(t, 0) for t, w in held[a].items())
            if value >= threshold:
                want[a, b] = value
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert (0, 202) in got
    if threshold > 0.4:
        # terms that all hold do not bring all together
        assert similarity.prefix_candidates(vectors, threshold).count() < 0.25 * len(rows) * (len(rows) - 1) / 2


def test_similar_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, term string, tf long, weight double")
    pairs, classes = similarity.similar_pairs(none, 0.5)
    assert pairs.count() == classes.count() == 0
    with pytest.raises(ValueError):
        similarity.similar_pairs(none, 0.0)


def test_levels_of_a_stored_graph_move_no_links(spark, monkeypatch):
    rows = [(f"n{i}", p, f"n{(i * 7 + p * 13) % 400}") for i in range(400) for p in range(6)] + [("n1", 9, "missing")]
    links = spark.createDataFrame(rows, "src string, pos int, dst string")
    plain = graph.level_graph(links, "n1", 4)
    held = graph.stored_links(links, 8, order=("pos",))
    plans = []
    cut = graph.cut_lineage

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", told)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cap in (None, 3):
            plans.clear()
            vertices, edges = graph.level_graph(held, "n1", 4, cap)
            assert len(plans) == 4
            for plan in plans[1:]:  # the first has one page's links only
                initial = plan.split("Initial Plan")[-1]
                before = initial[: initial.index("links_")].splitlines()
                scan = next(i for i, x in enumerate(before) if "links_" in x or i == len(before) - 1)
                depth = len(before[scan]) - len(before[scan].lstrip(" :+-*()0123456789"))
                above, reach = [], depth
                for line in reversed(before[:scan]):
                    indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
                    if indent < reach:
                        above.append(line)
                        reach = indent
                assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above), plan
            if cap is None:
                assert sorted(map(tuple, vertices.collect())) == sorted(map(tuple, plain[0].collect()))
                assert sorted(map(str, edges.collect())) == sorted(map(str, plain[1].collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    capped = graph.level_graph(links, "n1", 4, 3)
    assert sorted(map(tuple, vertices.collect())) == sorted(map(tuple, capped[0].collect()))
