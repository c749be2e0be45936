"""Pairs of near copies are listed about once, whatever number of tokens they share, and none is lost."""

import random

from dumpweave.llm import jaccard_join
from dumpweave.plans.session import store


def copies(words: int, changed: int, n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"x{i}y{at}"
        out.append(" ".join(text))
    return out


def roots(texts: list[str]) -> list[int]:
    """The smallest place that links reach, by comparing all with all."""
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)})
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def listed(spark, monkeypatch, texts):
    """(number of pairs listed, of distinct ones) before they are verified, and the components."""
    seen, plain = [], jaccard_join.map_partition

    def counted(df, function, ddl):
        out = plain(df, function, ddl)
        if "bits" in df.columns and ddl == "a long, b long":
            out = store(out)
            seen.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "map_partition", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, 4, 85, 100).collect()
    monkeypatch.undo()
    (counts,) = seen
    return counts, [x["component_id"] for x in sorted(found, key=lambda x: x["doc_id"])]


def test_unlinked_copies_are_listed_once(spark, monkeypatch):
    texts = copies(3000, 35, 12, 1)  # a similarity of about 0.83
    (rows, pairs), found = listed(spark, monkeypatch, texts)
    assert found == roots(texts) == list(range(12))
    assert 0 < rows <= 2 * pairs


def test_a_group_about_the_threshold_is_joined_first(spark, monkeypatch):
    texts = copies(150, 3, 60, 2) + copies(150, 2, 10, 3)
    (rows, _), found = listed(spark, monkeypatch, texts)
    assert found == roots(texts)
    assert rows <= len(texts)
