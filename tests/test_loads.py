"""Whole loads: what is written, and what is told about the rest."""

import bz2

import pytest
from pyspark.sql import functions as F

from dumpweave.operators import loads
from dumpweave.sources import sql_dump, xml_dump

NAME = "enwiki-20210420-pages-articles-multistream1.xml-p{}p{}.bz2"


def page(id_, title, text, ns=0, redirect="", end="</text>"):
    return (
        f"<page><title>{title}</title><ns>{ns}</ns><id>{id_}</id>{redirect}"
        f'<revision><id>1</id><text bytes="1" xml:space="preserve">{text}{end}</revision></page>'
    )


@pytest.fixture
def dump(tmp_path):
    files = {
        (1, 9): [
            page(1, "A &amp; B", "lead [[Dog|dogs]]\n== H ==\nbody"), page(2, "Old", "#REDIRECT", redirect='<redirect title="A" />'),
            page(3, "User:Z", "x", ns=2), page(4, "Twice", "first"), page(5, "Twice", "second"), page(6, "Broken", "x", end=""),
            page(7, "é" * 201, "x"), page(8, "Café", ""), "<page><title>cut",
        ],
        (10, 19): [page(10, "Twice", "third"), page(11, "Cafe", "same in ASCII"), page(12, "Known", "x"), page(13, "", "no title")],
    }
    for (first, last), pages in files.items():
        body = "<mediawiki>\n" + "\n".join(pages) + "\n</mediawiki>"
        (tmp_path / NAME.format(first, last)).write_bytes(bz2.compress(body.encode()))
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_load_text(spark, dump, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    existing = spark.createDataFrame([("Known",), (None,)], "title string")
    load = loads.load_text(xml_dump.read_xml_records(spark, dump), root, existing, chunk_pages=2)
    assert rows(load.tables["text"]) == rows(spark.createDataFrame([
        ("A & B", ["Lead", "H"], ["lead dogs", "body"], ["Dog"]), ("Twice", ["Lead"], ["first"], []), ("Cafe", [], [], []),
    ], load.tables["text"].schema))
    log = {(r.file_start, r.id): (r.chunk, r.title, r.status, r.reason) for r in load.log.collect() if r.id}
    assert log == {
        (1, 1): (0, "A & B", "added", None), (1, 2): (None, "Old", "left out", "redirect"),
        (1, 3): (None, "User:Z", "left out", "other namespace"), (1, 4): (0, "Twice", "added", None),
        (1, 5): (1, "Twice", "duplicate", None), (1, 7): (None, "e" * 201, "left out", "long title"),
        (1, 8): (1, "Cafe", "added", None), (10, 10): (0, "Twice", "duplicate", None), (10, 11): (0, "Cafe", "duplicate", None),
        (10, 12): (1, "Known", "duplicate", None), (10, 13): (None, "", "error", "invalid title"),
    }
    assert rows(load.log.where("id is null").select("file_start", "status", "reason")) == [(1, "error", "not well formed")] * 2
    assert rows(load.report("file_start")) == [(1, 6, 3, 1, 2), (10, 4, 0, 3, 1)]
    assert load.totals == {"added": 3, "duplicate": 4, "skipped": 0, "left out": 3, "error": 3}
    assert rows(load.status_totals(spark)) == [("added", 3), ("duplicate", 4), ("error", 3), ("left out", 3)]
    rejected = load.rejected.collect()
    assert {"Broken" in r.value for r in rejected} == {True, False} and all("p1p9" in r.file for r in rejected)


def test_a_dump_is_scanned_once(spark, dump, tmp_path, monkeypatch):
    scans, stored = [], []
    marked, store = loads.marked_xml_pages, loads.store

    def told(df):
        stored.append(df._jdf.queryExecution().toString())
        return store(df)

    monkeypatch.setattr(loads, "marked_xml_pages", lambda records: scans.append(1) or marked(records))
    monkeypatch.setattr(loads, "store", told)
    load = loads.load_text(xml_dump.read_xml_records(spark, dump), str(tmp_path / "out"))
    assert len(scans) == 1
    # the first stage reads the dump, once; nothing after it does
    physical = [plan.split("== Physical Plan ==")[1] for plan in stored]
    assert [plan.count("FileScan text") for plan in physical] == [1] + [0] * (len(physical) - 1)
    assert load.totals["added"] == 4


def test_load_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "file string, value string")
    load = loads.load_text(none, str(tmp_path))
    assert load.log.count() == load.rejected.count() == load.tables["text"].count() == 0 and not any(load.totals.values())
    load = loads.load_page_tables(none.select("value"), str(tmp_path))
    assert load.log.count() == load.rejected.count() == load.tables["page"].count() == load.tables["talk"].count() == 0


def test_records_without_a_dump_name(spark, tmp_path):
    made = [("x.xml", page(2, "T", "two")), (None, page(1, "T", "one")), ("x.xml", "no page here"), ("x.xml", None)]
    load = loads.load_text(spark.createDataFrame(made, "file string, value string"), str(tmp_path))
    assert rows(load.log.select("file_start", "chunk", "id", "title", "status")) == [
        (None, 0, 1, "T", "duplicate"), (None, 0, 2, "T", "added"),
    ]


LINES = [
    "-- comment", "CREATE TABLE `page` (", "",
    r"INSERT INTO `page` VALUES (10,0,'Accessible','',1,0),(12,0,'It\'s_(x),_y','',0,0),(13,1,'It\'s_(x),_y','',0,0),(14,1,'Orphan','',0,0);",
    f"INSERT INTO `page` VALUES (15,0,'{'t' * 201}','',0,0),(16,1,'{'t' * 201}','',0,0),(17,2,'User','',0,0),(NULL,0,'No_id','',0,0);",
    "INSERT INTO `page` VALUES garbage(18,0,'Fine','',0,0),(19,0),(20,0,NULL,'',0,0),(21,0,'cut",
    "INSERT INTO `page` VALUES nothing here;",
]


def test_load_page_tables(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    load = loads.load_page_tables(lines, str(tmp_path))
    assert rows(load.tables["page"]) == [(12, "It's (x), y"), (18, "Fine")]
    assert rows(load.tables["talk"]) == [(13, "It's (x), y")]
    assert {r.value for r in load.rejected.collect()} == {"(19,0)", "(21,0,'cut", "garbage", "nothing here"}
    assert load.totals == {"added": 3, "duplicate": 0, "skipped": 3, "left out": 2, "error": 6}
    log = {r.page_id: (r.table_name, r.status, r.reason) for r in load.log.where("page_id is not null").collect()}
    assert log == {
        10: ("page", "left out", "redirect"), 12: ("page", "added", None), 13: ("talk", "added", None), 14: ("talk", "skipped", "no page"),
        15: ("page", "skipped", "long title"), 16: ("talk", "skipped", "long title"), 17: (None, "left out", "other namespace"),
        18: ("page", "added", None), 20: ("page", "error", "invalid title"),
    }
    report = {r.table_name: tuple(r)[1:] for r in load.report("table_name").collect()}
    assert report == {"page": (5, 2, 0, 2), "talk": (3, 1, 0, 0), None: (4, 0, 0, 4)}


@pytest.mark.parametrize("kind", ["page", "link", "categorylink"])
def test_one_pass_agrees_with_two(spark, kind):
    more = ["INSERT INTO `x` VALUES (1,0,'a',0),(2,'b_c','d','e','f'),(x y),(3,'q'", "INSERT INTO `x` VALUES ;"]
    lines = spark.createDataFrame([(x,) for x in LINES + more], "value string")
    marked = sql_dump.marked_sql_dump(lines, kind)
    tuples = marked.where("is_tuple").drop("is_tuple", "rejected")
    assert rows(tuples) == rows(sql_dump.parse_sql_dump(lines, kind))
    assert rows(marked.where(F.col("rejected").isNotNull()).select("rejected")) == rows(sql_dump.rejected_sql_tuples(lines, kind))
