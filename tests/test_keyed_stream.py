"""Loading with the titles as keyed state."""

import json
import os

import pytest

from dumpweave.streaming import incremental
from dumpweave.streaming.incremental import load_log
from dumpweave.streaming.keyed import keyed_load

SCHEMA = "file_start long, chunk long, pos long, title string, text string"


def put(spark, folder, name, rows):
    made = spark.createDataFrame([(*r, f"text of {r}") for r in rows], SCHEMA).coalesce(1)
    made.write.parquet(f"{folder}/{name}")
    return made.schema


def log(spark, target, schema):
    return sorted(((r.file_start, r.chunk, r.pos, r.title, r.status) for r in load_log(spark, target, schema).collect()), key=str)


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "src dir"), str(tmp_path / "target"), str(tmp_path / "ck")


def test_a_batch_does_not_read_history(spark, folders, monkeypatch):
    source, target, checkpoint = folders
    monkeypatch.setattr(incremental, "_loaded", lambda *a: pytest.fail("history was read"))
    history = [(1, i // 10, i, f"T{i % 150}") for i in range(180)]
    schema = put(spark, source, "a", history)
    first = keyed_load(spark, f"{source}/*", schema, target, checkpoint)
    assert sum(b["input_rows"] for b in first) == 180 and first[-1]["titles"] == 150
    put(spark, source, "b", [(2, 0, 0, "T3"), (2, 0, 1, "new"), (2, 0, 2, "new"), (2, 1, 0, "new"), (2, 1, 1, None)])
    second = keyed_load(spark, f"{source}/*", schema, target, checkpoint)
    # of 150 titles none but the batch's own were touched
    assert sum(b["input_rows"] for b in second) == 5 and sum(b["new_titles"] for b in second) == 2
    monkeypatch.undo()
    got = {row[:3]: row[4] for row in log(spark, target, schema)}
    assert len(got) == 185
    # of a title in one chunk the last position is added, else the earliest chunk's
    for i in range(180):
        assert got[1, i // 10, i] == ("duplicate" if i >= 150 else "added")
    assert [got[2, 0, 0], got[2, 0, 1], got[2, 0, 2], got[2, 1, 0], got[2, 1, 1]] == ["duplicate", "duplicate", "added", "duplicate", "added"]
    texts = {r.title: r.text for r in load_log(spark, target, schema).where("status = 'added'").collect()}
    assert texts["new"] == "text of (2, 0, 2, 'new')" and texts["T7"] == "text of (1, 0, 7, 'T7')"


def test_a_replayed_batch_ends_as_if_it_ran_once(spark, folders):
    source, target, checkpoint = folders
    schema = put(spark, source, "a", [(1, 0, 0, "K"), (1, 0, 1, "T"), (1, 0, 2, "T")])
    existing = spark.createDataFrame([("K",), ("K",), ("other",)], "title string")
    keyed_load(spark, f"{source}/*", schema, target, checkpoint, existing=existing)
    put(spark, source, "b", [(2, 0, 0, "T"), (2, 0, 1, "U"), (2, 0, 2, "other")])
    keyed_load(spark, f"{source}/*", schema, target, checkpoint, existing=existing)
    want = log(spark, target, schema)
    assert [(t, s) for *_, t, s in want] == [
        ("K", "duplicate"), ("T", "duplicate"), ("T", "added"), ("T", "duplicate"), ("U", "added"), ("other", "duplicate"),
    ]
    # the last batch was written, but its commit was lost
    commits = sorted(int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    again = keyed_load(spark, f"{source}/*", schema, target, checkpoint, existing=existing)
    assert json.dumps(again) and log(spark, target, schema) == want


def test_files_per_batch(spark, folders):
    source, target, checkpoint = folders
    for i in range(3):
        schema = put(spark, source, f"f{i}", [(i, 0, j, f"T{j}") for j in range(4)])
    done = keyed_load(spark, f"{source}/*", schema, target, checkpoint, files_per_batch=1)
    assert [b["input_rows"] for b in done if b["input_rows"]] == [4, 4, 4]
    assert sum(row[4] == "added" for row in log(spark, target, schema)) == 4
