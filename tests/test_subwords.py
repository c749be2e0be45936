"""Sub-word lengths against a plain longest-match cut."""

import json
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpweave.operators import subwords

PUBLIC = "/opt/tokenizers/word_bpe_49k.json"


def words(text):
    return re.findall(r"[^\W_]+|[^\w\s]|_", text.lower())


def cut(word, starts, within, longest=100):
    """Number of pieces, or None."""
    if len(word) > longest:
        return None
    at, n = 0, 0
    while at < len(word):
        known = within if at else starts
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size:
            return None
        at, n = at + size, n + 1
    return n


def lengths(rows, starts, within, cap=None):
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, 0, 0))
            continue
        ids = []
        for w in words(text):
            n = cut(w, starts, within)
            ids += ["?"] if n is None else [w] * n
        ids = ids[: cap - 2] if cap else ids
        out.append((key, len(ids) + 2, ids.count("?")))
    return sorted(out, key=str)


def found(df, vocabulary, cap=None):
    return sorted(map(tuple, subwords.subword_lengths(df, vocabulary, "doc_id", cap).collect()), key=str)


ROWS = [
    (1, "Unaffable people, un-affable."), (2, None), (3, ""), (4, " \t\n"), (5, "x" * 101 + " " + "a" * 100),
    (6, "Ünä 中文 😀 don't"), (7, "unaffable unaffable"), (None, "un"), (8, "b"), (9, "a_a"),
]
PIECES = ["un", "##aff", "##able", "##a", "a", "people", ",", ".", "##n", "##", "#", None, "", "af", "##abl", "ünä", "##e", "_", "don", "'", "t"]


@pytest.mark.parametrize("cap", [None, 2, 3, 5, 60, 4100])
def test_lengths(spark, cap):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "total", "pos", "_key")})
    vocabulary = subwords.mark_pieces(spark.createDataFrame([(p,) for p in PIECES], "piece string"))
    starts = {p for p in PIECES if p and not (p.startswith("##") and len(p) > 2)}
    within = {p[2:] for p in PIECES if p and p.startswith("##") and len(p) > 2}
    assert found(rows, vocabulary, cap) == lengths(ROWS, starts, within, cap)
    assert found(rows.limit(0), vocabulary, cap) == []
    assert found(rows, vocabulary.limit(0), cap) == lengths(ROWS, set(), set(), cap)


@pytest.mark.skipif(not os.path.exists(PUBLIC), reason="no public vocabulary here")
def test_public_vocabulary(spark, tmp_path):
    with open(PUBLIC, encoding="utf8") as file:
        known = json.load(file)["model"]["vocab"]
    pieces = {("" if p.endswith("</w>") else "##") + p.removesuffix("</w>") for p in known}
    (tmp_path / "vocab.txt").write_text("\n".join(sorted(p for p in pieces if p.isprintable())), encoding="utf8")
    vocabulary = subwords.read_vocabulary(spark, str(tmp_path / "vocab.txt"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    starts = {p for p in pieces if p.isprintable() and not p.startswith("##") and p}
    within = {p[2:] for p in pieces if p.isprintable() and p.startswith("##") and len(p) > 2}
    rows = [tuple(r) for r in docs.collect()]
    got = found(docs, vocabulary)
    assert got == lengths(rows, starts, within)
    assert sum(r[2] for r in got) < 0.2 * sum(r[1] for r in got)
    share = subwords.unknown_subword_share(subwords.subword_lengths(docs, vocabulary, "doc_id")).first()
    assert (share.n_unknown, share.n_tokens) == (sum(r[2] for r in got), sum(r[1] for r in got))


def test_no_word_is_cut_twice_or_in_python(spark):
    rows = spark.createDataFrame([(i, "many many words " * 5) for i in range(50)], "doc_id long, text string")
    cut_ = subwords.cut_words(rows.select(F.explode(subwords.plain_words(F.col("text"))).alias("word")), subwords.mark_pieces(
        spark.createDataFrame([("many",), ("w",), ("##ord",), ("##s",)], "piece string")
    ))
    assert sorted(map(tuple, cut_.collect())) == [("many", 1, False), ("words", 3, False)]
    assert "Python" not in cut_._jdf.queryExecution().toString()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abc", max_size=9), min_size=1, max_size=12), st.sets(st.text("abc", min_size=1, max_size=3), max_size=9), st.sets(st.text("abc", min_size=1, max_size=3), max_size=9))
def test_any_vocabulary(spark, texts, starts, within):
    rows = list(enumerate(texts))
    pieces = [(p, True) for p in starts] + [(p, False) for p in within]
    vocabulary = spark.createDataFrame(pieces, "piece string, is_start boolean")
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary) == lengths(rows, starts, within)
