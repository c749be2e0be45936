"""Vectors in packs: the rows of the long form, and all similar pairs, without a row for each pair that shares a term."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_tfidf_blocks import TEXTS

from dumpweave.operators import packs, similarity
from dumpweave.plans.session import configure


@pytest.fixture
def apart(spark):
    """Small tables stay in as many parts as the shuffles have."""
    configure(spark).conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def long_texts(n, near, rng):
    """Texts of the same few hundred words, unlike each other all the same, and some that are near copies."""
    rows = []
    for doc in range(n):
        words = [f"common{i}" for i in rng.integers(0, 300, 400)] + [f"seldom{doc % 7}"] * 3
        rows.append((doc, " ".join(words)))
    rows += [(n + i, rows[i][1] + f" seldom{i} tail{i % 2}") for i in range(near)]
    return rows


@pytest.mark.parametrize("texts", [TEXTS, [(i, t) for i, (_, t) in enumerate(TEXTS)], TEXTS[-1:]])
def test_packs_hold_the_rows_of_the_long_form(apart, texts):
    docs = apart.createDataFrame(texts, "doc long, text string").repartition(5)
    told = lambda df: {(r.doc, r.term): (r.tf, r.weight) for r in df.collect()}
    made = similarity.tfidf(docs, packed=True)
    assert len(texts) < 2 or made.count() > 1
    found, want = told(packs.unpacked(made)), told(similarity.tfidf(docs))
    assert found.keys() == want.keys()
    for key, (tf, weight) in want.items():
        assert found[key] == (tf, pytest.approx(weight, abs=1e-12))


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0 - 1e-6])
def test_similar_pairs_of_packs_are_those_of_the_long_form(apart, threshold):
    rng = np.random.default_rng(7)
    rows = long_texts(40, 9, rng) + [(100, None), (101, ""), (102, "alone"), (None, "common1 common2")]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, rows[0][1] + " " + rows[0][1]), (41, "common1 more")]
    docs = apart.createDataFrame(rows, "doc long, text string").repartition(4)
    pairs, classes = similarity.similar_pairs(similarity.tfidf(docs, packed=True), threshold)
    vectors = similarity.tfidf(docs).localCheckpoint()
    held = {}
    for r in vectors.collect():
        held.setdefault(r.doc, {})[r.term] = r.weight
    told = {r.doc: r.representative for r in classes.collect()}
    assert told == {r.doc: r.representative for r in similarity.vector_classes(vectors).collect()}
    assert told[200] == 0 and told[300] == 300
    chosen = sorted({d for d, first in told.items() if d is not None and d == first})
    want = {}
    for i, a in enumerate(chosen):
        for b in chosen[i + 1 :]:
            value = sum(w * held[b].get(t, 0) for t, w in held[a].items())
            if value >= threshold:
                want[a, b] = value
    assert (0, 300) in want
    for told_pairs in (pairs, similarity.similar_pairs(vectors, threshold)[0]):
        found = [(r.a, r.b, r.similarity) for r in told_pairs.collect()]
        assert Counter((a, b) for a, b, _ in found) == Counter(list(want))
        assert all(abs(value - want[a, b]) < 1e-9 for a, b, value in found)


def test_long_texts_that_share_words_are_no_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(doc, " ".join(f"w{int(2000 * u**3)}" for u in rng.random(400))) for doc in range(120)]
    rows += [(120 + i, rows[i][1] + f" seldom{i}") for i in range(10)]
    vectors = similarity.tfidf(configure(spark).createDataFrame(rows, "doc long, text string")).localCheckpoint()
    pairs = similarity.similar_pairs(vectors, 0.8)[0]
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, 120 + i) for i in range(10)}
    # nearly all of 8,385 pairs share a listed term
    assert similarity.prefix_candidates(vectors, 0.8).count() <= 20


def test_neither_pairs_nor_vectors_are_shuffled(spark):
    docs = configure(spark).createDataFrame(long_texts(20, 2, np.random.default_rng(3)), "doc long, text string")
    pairs, _ = similarity.similar_pairs(similarity.tfidf(docs, packed=True), 0.8)
    assert not re.search("Exchange|Join", pairs._jdf.queryExecution().executedPlan().toString())


def test_similar_pairs_of_no_packs(spark):
    none = configure(spark).createDataFrame([(1, None)], "doc long, text string")
    for docs in (none, none.where("doc = 2")):
        pairs, classes = similarity.similar_pairs(similarity.tfidf(docs, packed=True), 0.5)
        assert pairs.count() == classes.count() == 0


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(11)
    folder, at, parts = str(tmp_path_factory.mktemp("blocks")), 0, []
    for n in (70, 45):
        vectors = []
        for i in range(n):
            if i % 9 == 8:
                held = dict(vectors[-1])
                held[int(rng.integers(0, 500))] = 0.4
            else:
                chosen = (500 * rng.random(rng.integers(1, 150)) ** 0.5).astype(int)
                held = {int(t): float(rng.integers(1, 9)) * (8 - t / 80) for t in chosen}
            vectors.append(held)
        unit = [{t: w / np.sqrt(sum(x * x for x in v.values())) for t, w in sorted(v.items())} for v in vectors]
        parts.append(
            (
                pa.array(range(at, at + n)),
                np.array([len(v) for v in unit]),
                np.array([t for v in unit for t in v]),
                np.array([w for v in unit for w in v.values()]),
            )
        )
        at += n
    return [next(packs._written(folder, iter([part])))["path"] for part in parts], parts


@pytest.mark.parametrize("cells, products", [(10, 1), (900, 40), (1_000_000, 1_000_000)])
@pytest.mark.parametrize("dense", [0, 1 / 16, 1e9])
@pytest.mark.parametrize("matrix, columns", [(0, 4096), (0.05, 20), (9, 4096)])
def test_blocks_find_all_pairs_however_they_sum(files, monkeypatch, cells, products, dense, matrix, columns):
    for name, value in (("CELLS", cells), ("PRODUCTS", products), ("DENSE", dense), ("MATRIX", matrix), ("COLUMNS", columns)):
        monkeypatch.setattr(packs, name, value)
    paths, parts = files
    full = np.zeros((115, 500))
    for docs, sizes, ids, weights in parts:
        full[np.repeat(docs.to_numpy(), sizes), ids] = weights
    cosine = full @ full.T
    for threshold in (0.5, 0.8):
        blocks = [packs._Block(path, packs._cuts(500), threshold) for path in paths]
        found = []
        for one, two in ((blocks[0], blocks[0]), (blocks[0], blocks[1]), (blocks[1], blocks[1])):
            for a, b in packs._candidates(one, two, threshold):
                value = packs._products(one, two, a, b, np.zeros(500))
                x, y = np.array(one.docs)[a], np.array(two.docs)[b]
                assert np.allclose(value, cosine[x, y], atol=1e-12)
                kept = value >= threshold
                found += [(min(p), max(p)) for p in zip(x[kept].tolist(), y[kept].tolist(), strict=True)]
        want = [(i, j) for i in range(115) for j in range(i + 1, 115) if cosine[i, j] >= threshold]
        assert want and sorted(found) == want
