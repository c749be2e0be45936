"""TF-IDF by blocks of documents: the same weights however they are dealt out, and no row of a term shuffled."""

import math
import re
from collections import Counter

import pytest

from dumpweave.operators import similarity
from dumpweave.plans.session import configure

TEXTS = [(i % 50, f"word{i % 7} Word{i % 3} x rare{i} ærø " * (i % 4)) for i in range(120)] + [(7, None), (None, "no number"), (99, "")]


def plain():
    counts = {}
    for doc, text in TEXTS:
        counts.setdefault(doc, Counter()).update(re.findall(r"\w{2,}", (text or "").lower()))
    df = Counter(t for c in counts.values() for t in c)
    found = {}
    for doc, c in counts.items():
        raw = {t: n * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        found |= {(doc, t): (c[t], x / norm) for t, x in raw.items()}
    return found


@pytest.mark.parametrize("block_docs", [1, 10, 500])
def test_weights(spark, monkeypatch, block_docs):
    monkeypatch.setattr(similarity, "BLOCK_DOCS", block_docs)
    vectors = similarity.tfidf(configure(spark).createDataFrame(TEXTS, "doc long, text string"))
    found = {(r.doc, r.term): (r.tf, r.weight) for r in vectors.collect()}
    want = plain()
    assert found.keys() == want.keys()
    for key, (tf, weight) in want.items():
        assert found[key] == (tf, pytest.approx(weight))


def test_terms_of_documents_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_DOCS", 1)
    vectors = similarity.tfidf(configure(spark).createDataFrame(TEXTS, "doc long, text string"))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"(_block|term)#\d+L?", x) for x in dealt), dealt
