import bz2

import pytest
from pyspark.sql import functions as F

from dumpweave.operators.checks import dump_contiguity, require_contiguous
from dumpweave.operators.pages import article_pages, clean_title, pages_in_namespace
from dumpweave.sources.sql_dump import parse_sql_dump, read_sql_dump, read_sql_dump_lines
from dumpweave.sources.xml_dump import (
    dump_file_listing,
    read_xml_pages,
    valid_dump_file,
    valid_file_range,
)

STEM = "xywiki-20210420-pages-articles-multistream"


def xml_page(title, text, ns=0, page_id=1, redirect=None):
    mark = f'<redirect title="{redirect}" />' if redirect else ""
    body = f'<text bytes="1" xml:space="preserve">{text}</text>' if text else '<text bytes="0" />'
    return (
        f"  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n    <id>{page_id}</id>\n    {mark}\n"
        f"    <revision>\n      <id>{page_id + 100}</id>\n      {body}\n    </revision>\n  </page>\n"
    )


def write_dump(path, pages, per_stream=2):
    head = '<mediawiki xmlns="http://example.org/export-0.10/" version="0.10">\n<siteinfo />\n'
    streams = [bz2.compress(head.encode())]
    for i in range(0, len(pages), per_stream):
        streams.append(bz2.compress("".join(pages[i : i + per_stream]).encode()))
    streams.append(bz2.compress(b"</mediawiki>\n"))
    path.write_bytes(b"".join(streams))


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    write_dump(
        folder / f"{STEM}1.xml-p1p5.bz2",
        [
            xml_page("A &amp; B", "lead\n== One ==\nx &lt; y\n== Two ==\nz", page_id=1),
            xml_page("Old name", "#REDIRECT", page_id=2, redirect="A &amp; B"),
            xml_page("User:Z", "x", ns=2, page_id=3),
            xml_page("Film: Sequel", "x", page_id=4),
            xml_page("Ends:", "x", page_id=5),
        ],
    )
    write_dump(
        folder / f"{STEM}2.xml-p6p9.bz2",
        [
            xml_page("é" * 200, "x", page_id=6),
            xml_page("é" * 201, "x", page_id=7),
            xml_page("Empty", "", page_id=8),
            xml_page("1984", "  two\nlines ", page_id=9),
        ],
    )
    (folder / "xywiki-20210420-pages-articles-multistream.xml.bz2").write_bytes(b"x")
    (folder / "notes.txt").write_text("x")
    return folder


def test_listing(spark, dump):
    rows = dump_file_listing(spark, str(dump)).collect()
    assert [(r.start_idx, r.end_idx) for r in rows] == [(1, 5), (6, 9)]
    assert rows[0].path.endswith(f"{STEM}1.xml-p1p5.bz2")


def test_listing_errors(spark, dump, tmp_path):
    with pytest.raises(FileNotFoundError):
        dump_file_listing(spark, str(dump / "missing"))
    with pytest.raises(NotADirectoryError):
        dump_file_listing(spark, str(dump / "notes.txt"))
    (tmp_path / f"{STEM}1.xml-pxp5.bz2").write_bytes(b"x")
    with pytest.raises(ValueError):
        dump_file_listing(spark, str(tmp_path))


def test_valid_names(spark):
    stem = "enwiki-20210420-pages-articles-multistream21"
    names = [
        (f"/d/{stem}.xml-p37022433p38522432.bz2", True),
        (f"/d/{stem}.xml-p37022433p38522432.txt", False),
        (f"/d/{stem}.txt.bz2", False),
        (f"/d/{stem}.txt.txt", False),
        (f"/d.x/{stem}.a.xml-p1p2.bz2", False),
    ]
    paths = spark.createDataFrame([(n,) for n, _ in names], "path string")
    found = {r.path: r.is_valid for r in valid_dump_file(paths).collect()}
    assert found == dict(names)


def test_valid_ranges(spark):
    files = spark.createDataFrame(
        [("a", 5, 8), ("b", 5, 5), ("c", 9, 8), (None, 1, 2), ("d", None, 2)],
        "path string, start_idx bigint, end_idx bigint",
    )
    found = {r.path: r.reason for r in valid_file_range(files).collect()}
    assert found["a"] is None and found["b"] is None
    assert "above" in found["c"] and "path" in found[None] and "start_idx" in found["d"]


@pytest.mark.parametrize(
    "files, contiguous, last",
    [
        ([(1, 5), (6, 10), (11, 15)], True, "f11"),
        ([(1, 8), (6, 10), (11, 15)], False, "f1"),
        ([(1, 5), (6, 10), (13, 15)], False, "f6"),
        ([(6, 10), (1, 5), (11, 15)], True, "f11"),
        ([(2, 5), (6, 10)], False, None),
    ],
)
def test_contiguity(spark, files, contiguous, last):
    df = spark.createDataFrame(
        [(f"f{s}", s, e) for s, e in files], "path string, start_idx bigint, end_idx bigint"
    )
    assert dump_contiguity(df).collect() == [(contiguous, last)]
    if contiguous:
        require_contiguous(df)
    else:
        with pytest.raises(FileNotFoundError):
            require_contiguous(df)


def test_xml_pages(spark, dump):
    pages = read_xml_pages(spark, f"{dump}/{STEM}*.xml-p*.bz2")
    rows = {r.title: r for r in pages.collect()}
    assert len(rows) == 9
    assert rows["A & B"].text == "lead\n== One ==\nx < y\n== Two ==\nz"
    assert rows["A & B"].file.endswith("p1p5.bz2")
    assert rows["Old name"].is_redirect and rows["Old name"].redirect_title == "A & B"
    assert rows["Empty"].text == "" and rows["1984"].text == "  two\nlines "
    kept = {r.title: r.title_ascii for r in article_pages(pages).collect()}
    assert set(kept) == {"A & B", "Ends:", "é" * 200, "Empty", "1984"}
    assert kept["é" * 200] == "e" * 200
    by_ns = {r.title for r in article_pages(pages, "ns").collect()}
    assert by_ns == set(kept) | {"Film: Sequel"}


def test_one_file_is_split_among_tasks(spark, tmp_path):
    # incompressible text, so that the file has many bz2 blocks
    import random

    rng = random.Random(5)
    pages = [
        xml_page(f"T{i}", "".join(rng.choices("abcdefghijklmnop \n", k=3000)), page_id=i)
        for i in range(1500)
    ]
    write_dump(tmp_path / f"{STEM}1.xml-p1p1500.bz2", pages, per_stream=100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150000")
    try:
        found = read_xml_pages(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 8
        row = found.agg(
            F.count("*"), F.countDistinct("id"), F.sum(F.length("text")), F.min(F.length("text"))
        ).first()
        assert tuple(row) == (1500, 1500, 1500 * 3000, 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


LONG = "x" * 201
PAGE_DUMP = f"""-- MySQL dump

CREATE TABLE `page` (x int);
INSERT INTO `page` VALUES (10,0,'Accessible_Computing','',1,0,0.33,'20210501','20210502',1,111,'wikitext',NULL),(12,0,'It\\'s_(x),_y','',0,0,0.5,'20210501',NULL,2,9,'wikitext',NULL);
INSERT INTO `page` VALUES (13,1,'It\\'s_(x),_y','',0,0,0.7,'2','3',4,5,NULL,NULL),(14,1,'Orphan','',0,0,0.1,'1','1',1,1,'w',NULL),(15,0,'{LONG}','',0,0,0.1,'1','1',1,1,'w',NULL),(16,0,'a\\\\\\\\b\\"c','sysop',0,0,0.1,'1','1',1,1,'w',NULL);
"""


@pytest.fixture(scope="module")
def page_dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("sql") / "page.sql"
    path.write_text(PAGE_DUMP)
    return str(path)


def test_page_dump(spark, page_dump):
    assert read_sql_dump_lines(spark, page_dump).count() == 2
    rows = {r.page_id: r for r in read_sql_dump(spark, page_dump, "page", tasks=4).collect()}
    assert sorted(rows) == [10, 12, 13, 14, 15, 16]
    assert rows[12].title == "It's_(x),_y" and rows[10].is_redirect == 1
    assert rows[16].title == 'a\\\\b"c' and rows[16].restrictions == "sysop"
    raw = {r.page_id: r.title for r in read_sql_dump(spark, page_dump, "page", unescape=False).collect()}
    assert raw[12] == "It\\'s_(x),_y"


def test_page_dump_to_tables(spark, page_dump):
    pages = read_sql_dump(spark, page_dump, "page")
    assert {r.page_id for r in pages_in_namespace(pages, 0).collect()} == {12, 15, 16}
    cleaned = {r.page_id: r for r in clean_title(pages_in_namespace(pages, 0)).collect()}
    assert cleaned[12].page_title == "It's (x), y" and cleaned[12].status == "kept"
    assert cleaned[15].status == "skipped"


def test_other_dumps(spark):
    lines = spark.createDataFrame(
        [
            ("INSERT INTO `pagelinks` VALUES (1,0,'A_b',0),(2,4,'C)\\',(','1'),(3,0,'',0);",),
            ("-- no data (1,0,'x',0)",),
        ],
        "value string",
    )
    found = [tuple(r) for r in parse_sql_dump(lines, "link").orderBy("pl_from").collect()]
    assert found[0] == (1, 0, "A_b", 0)
    assert found[1][:3] == (2, 4, "C)',(") and found[2][2] == ""
    lines = spark.createDataFrame(
        [("INSERT INTO `categorylinks` VALUES (7,'B-Class_x','S,(\\n','2021','','uca','page'),(8,'Y','',NULL,'','','page');",)],
        "value string",
    )
    assert {tuple(r) for r in parse_sql_dump(lines, "categorylink").collect()} == {
        (7, "B-Class_x"), (8, "Y"),
    }
    with pytest.raises(ValueError):
        parse_sql_dump(lines, "redirect")


def test_broken_pages_and_tuples_are_kept_apart(spark):
    from dumpweave.sources.sql_dump import parse_sql_dump, rejected_sql_tuples
    from dumpweave.sources.xml_dump import parse_xml_pages, rejected_xml_pages

    body = "<page><title>{}</title><ns>0</ns><id>1</id><revision><id>2</id><text>{}</text></revision>"
    records = spark.createDataFrame([(body.format("Good", "a"),), (body.format("Bad", "a < b"),)], "value string")
    assert [r.title for r in parse_xml_pages(records).collect()] == ["Good"]
    assert ["Bad" in r["value"] for r in rejected_xml_pages(records).collect()] == [True]
    line = "INSERT INTO `categorylinks` VALUES (1,_binary 'C',''),(2,'D',),(oops(,(3,'E','x');"
    lines = spark.createDataFrame([(line,)], "value string")
    assert parse_sql_dump(lines, "categorylink").count() == 3
    assert [r["value"] for r in rejected_sql_tuples(lines, "categorylink").collect()] == ["(oops("]


def test_marks_of_any_depth(spark):
    from dumpweave.functions.wikitext import strip_markup

    deep = "a" + "{{x|" * 10 + "}}" * 10 + "b{{p|{q}}}{{r|{{{1}}}}}c {{open [[File:f|see [[A|B]]]]"
    row = spark.createDataFrame([(deep,)], "t string").select(strip_markup(F.col("t")).alias("t")).first()
    assert row.t == "abc {{open see B"
