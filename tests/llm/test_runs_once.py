"""The runs of texts are found once and read from a table."""

import numpy as np

from dumpweave.llm import substring_dedup


def test_runs_are_found_once(spark, monkeypatch):
    steps = []

    def spy(df, **options):
        steps.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return store(df, **options)

    store = substring_dedup.store
    monkeypatch.setattr(substring_dedup, "store", spy)
    same = "".join(f"{i} " for i in range(200))
    rows = [(1, "a" + same + "b"), (2, "c" + same), (3, "short"), (4, None)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = len(same)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in found} == {1: (size + 2, size), 2: (size + 1, size), 3: (5, 0), 4: (0, 0)}
    # the runs by themselves; then the cut and the search
    assert steps == [1, 2]


def test_sliding_minimum():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 137, 300):
        values = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for width in {1, 2, 3, n // 2 + 1, n}:
            plain = [values[i : i + width].min() for i in range(n - width + 1)]
            assert substring_dedup._sliding_minimum(values, width).tolist() == plain
