"""Steps of markup removal and transliteration stand in a plan once, and give what they gave."""

import random
import re

from pyspark.sql import functions as F

from dumpweave.functions import translit, wikitext


def mentions(df, word: str) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"\b{word}\b", plan))


def test_steps_are_not_repeated_in_one_another(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.createDataFrame([("a",)], "text string").select(wikitext.strip_markup(F.col("text")).alias("t"))
    # verbatim text, templates, tables, links
    assert mentions(df, "regexp_extract_all") == 4
    df = spark.createDataFrame([("a",)], "text string").select(translit.transliterate(F.col("text")).alias("t"))
    assert mentions(df, "replace") == 0 and mentions(df, "translate") == 1


def test_pieces_of_single_marks(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["[", "]", "[[", "]]", "a", "|", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(wikitext._pieces(F.col("text"), r"\[", r"\]")).collect()]
    marks = re.compile(r"\[\[|\]\](?!\](?!\]))")
    for text, pieces in zip(texts, got, strict=True):
        assert "".join(pieces) == text
        assert [p for p in pieces if p in ("[[", "]]")] == marks.findall(text)


def test_longer_forms_of_every_character(spark):
    source, target, longer = translit.ascii_tables()
    rows = [(chr(c), f"a{chr(c)}b{chr(c)}{chr(c)}ß") for c in range(0x80, 0x2200)] + [("", ""), ("", None)]
    df = spark.createDataFrame(rows, "c string, text string").repartition(4)
    plain = {ord(a): b for a, b in zip(source, target, strict=True)} | {ord(a): b for a, b in longer}
    for row in df.select("c", "text", translit.transliterate(F.col("text")).alias("t")).collect():
        if row["text"] is None:
            assert row["t"] is None
        elif not row["c"] or ord(row["c"]) in plain:
            assert row["t"] == row["text"].translate(plain)
