"""Counts of n-grams by blocks and bins: the same scores however they are cut, and little to store."""

import os

import numpy as np
import pytest

from dumpweave.llm import interpolated_lm as lm
from dumpweave.plans import session


def test_numbers_come_back_from_their_planes():
    values = np.array([0, 1, 2**40, 2**64 - 1], dtype=np.uint64)
    assert (lm._unpack(lm._pack(values)) == values).all()
    assert len(lm._unpack(lm._pack(values[:0]))) == 0


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_tables_take_less_than_a_trigram_by_its_words(docs, monkeypatch):
    stored = []

    def store(df, **options):
        stored.append(session.store(df, **options))
        return stored[-1]

    kept = []
    monkeypatch.setattr(lm, "store", store)
    monkeypatch.setattr(lm, "discard", lambda df: kept.append(df))
    whole = {r.doc_id: r for r in lm.held_out_scores(docs).collect()}
    n_tokens = sum(r.n_tokens for r in whole.values())
    assert sum(_size(x.stage_path.removeprefix("file:")) for x in stored) < 24 * n_tokens
    monkeypatch.setattr(lm, "HEAD", 20_000)
    monkeypatch.setattr(lm, "BIN_KEYS", 5_000)
    for r in lm.held_out_scores(docs).collect():
        same = whole[r.doc_id]
        assert tuple(r)[:5] == tuple(same)[:5]
        assert (r.base_score, r.score) == pytest.approx((same.base_score, same.score), rel=1e-9)


def test_shuffles_of_a_stored_table_are_gone(spark):
    stored = session.store(spark.range(100_000).groupBy("id").count())
    assert stored.count() == 100_000
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = status.size()
    session.store(spark.range(100_000).groupBy("id").count())
    assert status.size() <= before
