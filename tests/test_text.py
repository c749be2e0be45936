import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpweave.fixed_values import ASCII_FORMS, STOP_WORDS_AS_RECORDED
from dumpweave.functions import text as tx
from dumpweave.functions.translit import transliterate
from dumpweave.functions.wikitext import extract_links, extract_sections, strip_markup
from dumpweave.operators.stats import (
    length_histogram,
    length_percentiles,
    length_summary,
    unknown_share,
)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


WIKITEXT = "The '''lead''' {{box|{{n}}}}\n== A ==\ntext <!-- no -->\n=== B ===\n== C ==\nCafé [[Dog|dogs]]"


def sections(spark, value, **options):
    row = extract_sections(spark.createDataFrame([(value,)], "text string"), **options).first()
    return row.headings, row.sections


def test_sections(spark):
    assert sections(spark, WIKITEXT) == (
        ["Lead", "A", "B", "C"], ["The lead", "text", "", "Cafe dogs"],
    )
    assert sections(spark, "just text") == (["Lead"], ["just text"])
    assert sections(spark, "just text", keep_headless=False) == ([], [])
    assert sections(spark, None) == ([], []) and sections(spark, "") == ([], [])
    assert sections(spark, "== É ==\nx") == (["Lead", "É"], ["", "x"])


LINKS = (
    "[[Dog]] [[Dog|dogs]] [[Dog]] [[File:x.jpg|thumb|see [[Cat]]]] [[Category:Pets]] [[ ]] [[Café#Menu]]"
)


def test_links(spark):
    text = F.col("t")
    assert one(spark, extract_links(text), LINKS) == ["Dog", "Dog", "Dog", "Cat", "Cafe"]
    display = one(spark, extract_links(text, use="display"), LINKS)
    assert display == ["Dog", "dogs", "Dog", "Cat", "Cafe#Menu"]
    assert one(spark, extract_links(text), None) == []
    assert one(spark, extract_links(text, use="display"), None) == []
    nested = "[[Image:a|left|by [[B|b]]]] [[open"
    assert one(spark, extract_links(text, use="display"), nested) == ["left|by b", "b"]


@pytest.mark.parametrize(
    "value, shown",
    [
        (None, ""),
        ("a<!-- x\ny -->b", "ab"),
        ("a {{x|{{y|{{z}}}}}} b", "a  b"),
        ("[[A]] [[B|c]] [http://x.org d e] [http://x.org]", "A c d e "),
        ("'''bold''' it''s", "bold its"),
        ("x<ref name=a>y</ref><br/> 1 < 2", "xy 1 < 2"),
        ("== H ==\ntext", "H\ntext"),
        ("a&nbsp;b &amp;lt; &lt;", "a b &lt; <"),
    ],
)
def test_markup(spark, value, shown):
    assert one(spark, strip_markup(F.col("t")), value) == shown


def by_character(text, fixed):
    out = []
    for char in text:
        if ord(char) < 128:
            out.append(char)
        elif char in fixed:
            out.append(fixed[char])
        else:
            form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            out.append(form)
    return "".join(out)


LATIN = "".join(map(chr, range(0x20, 0x7F))) + "".join(map(chr, range(0xC0, 0x180))) + "–’“”…ạệﬁ漢"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=LATIN, max_size=30), min_size=1, max_size=20))
def test_transliterate(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("t", transliterate(F.col("t")).alias("a"), transliterate(F.col("t"), "nfkd").alias("n"))
    known = set(LATIN) - {"漢", "ŉ"}
    for row in rows.collect():
        text = "".join(c for c in row.t if c in known)
        if text == row.t:
            assert row.a == by_character(row.t, ASCII_FORMS)
            assert row.n.isascii() and row.a.isascii()


def test_transliterate_known(spark):
    assert one(spark, transliterate(F.col("t")), "Bohr–Einstein: Größe, Æsir, Łódź") == (
        "Bohr-Einstein: Grosse, AEsir, Lodz"
    )
    assert one(spark, transliterate(F.col("t"), "nfkd"), "Größe") == "Groe"
    assert one(spark, transliterate(F.col("t")), None) is None


def test_transliterate_other_scripts(spark):
    from dumpweave.functions.translit import transliteration_status
    from dumpweave.operators import checks

    forms = {
        "Αθήνα": "Athena", "Ψυχή": "Psukhe", "Ξένος ᾄδω": "Ksenos ado", "Москва": "Moskva",
        "Щукин Юрий": "Shchukin Iurii", "объект": 'ob"ekt', "Київ": "Kiyiv", "Ђоковић": "Djokovitsh",
        "漢字 é": "漢字 e", "हिन्दी": "हिन्दी", "x ☃ y": "x  y", "e\u0301": "e",
    }
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    found = df.select("t", transliterate(F.col("t")).alias("a"), transliteration_status(F.col("t")).alias("s")).collect()
    assert {r.t: r.a for r in found} == forms
    assert {r.t for r in found if r.s == "partly"} == {"漢字 é", "हिन्दी"}
    titles = spark.createDataFrame([("漢字",), ("東京",), ("Пётр",), ("Иван",), ("plain",)], "title string")
    assert [tuple(r) for r in checks.translit_collisions(titles).collect()] == [("", 2, "東京", "漢字")]
    assert {r.title for r in checks.untransliterated_titles(titles).collect()} == {"漢字", "東京"}


def test_stop_words(spark):
    text = "The dog, the  Dog\nand ours"
    assert one(spark, tx.remove_stopwords(F.col("t")), text) == "dog, Dog"
    recorded = tx.remove_stopwords(F.col("t"), stop_words=STOP_WORDS_AS_RECORDED)
    assert one(spark, recorded, text) == "dog, Dog ours"
    assert one(spark, tx.remove_stopwords(F.col("t"), first=1), text) == "dog,"
    assert one(spark, tx.remove_stopwords(F.col("t")), " the, a ") == "the,"


def test_lines_terms_slugs(spark):
    assert one(spark, tx.collapse_lines(F.col("t")), " a \n\n b") == "ab"
    assert one(spark, tx.tokenize_terms(F.col("t")), "It's a Día_1 x!") == ["it", "día_1"]
    assert one(spark, tx.slug(F.col("t")), "a b c") == "a_b_c"
    assert one(spark, tx.unslug(F.col("t")), "a_b_c") == "a b c"
    colours = {"m": "blue", "f": "pink"}
    assert one(spark, tx.colour_by_attribute(F.col("t"), colours), "f") == "pink"
    assert one(spark, tx.colour_by_attribute(F.col("t"), colours, "grey"), None) == "grey"


def lead_pages(spark):
    return spark.createDataFrame(
        [("a", ["one two three"]), ("b", [""]), ("c", []), ("d", ["w " * 50])],
        "title string, sections array<string>",
    )


def test_lead_lengths(spark):
    found = {r.title: r.length for r in tx.lead_token_length(lead_pages(spark), cap=12).collect()}
    assert found == {"a": 5, "b": 2, "c": 0, "d": 12}
    words = tx.lead_token_length(lead_pages(spark), tokenizer=lambda c: F.split(c, " "))
    assert {r.title: r.length for r in words.collect()}["a"] == 5


def test_unknown_share(spark):
    vocabulary = spark.createDataFrame([("one",), ("w",), ("w",)], "token string")
    row = unknown_share(lead_pages(spark), vocabulary, cap=12).first()
    assert (row.n_unknown, row.n_tokens) == (2, 5 + 2 + 12)
    assert row.percent_unknown == pytest.approx(100 * 2 / 19)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80))
def test_length_statistics(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "length bigint")
    row = length_summary(df).first()
    assert row.max_length == max(values) and row.sum_length == sum(values)
    assert row.mean_length == pytest.approx(np.mean(values))
    assert row.median_length == pytest.approx(np.median(values))
    shares = [0.05, 0.5, 0.9999]
    got = [r.value for r in length_percentiles(df, shares=shares).orderBy("share").collect()]
    assert got == pytest.approx(list(np.percentile(values, [5, 50, 99.99])))
    bins = length_histogram(df, bins=7).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=7)
    assert [b.lower for b in bins] + [bins[-1].upper] == pytest.approx(list(edges))
    # a value on an inner edge may fall on either side of it by rounding
    assert sum(b.n for b in bins) == len(values) == counts.sum()


def test_percentiles_of_ten(spark):
    df = spark.range(10).withColumnRenamed("id", "length")
    found = length_percentiles(df, shares=[0.05, 0.5, 0.9999]).orderBy("share").collect()
    assert [r.value for r in found] == pytest.approx([0.45, 4.5, 8.9991])


BLOCKS = [
    ("a <nowiki>[[b]] {{c}} ''d'' &amp;</nowiki> e", "a [[b]] {{c}} ''d'' & e"),
    ("<pre>\n== no heading ==\n</pre>", "\n== no heading ==\n"),
    ("x <nowiki> open", "x  open"),
    ("<!-- <nowiki> -->a [[b]]</nowiki>", "a b"),
    ("<nowiki><!-- shown --></nowiki>", "<!-- shown -->"),
    ("<nowiki/>a<nowiki />", "a"),
    ("<syntaxhighlight lang=\"c\">if (a[0] == '{') </syntaxhighlight>", "if (a[0] == '{') "),
    ("a <math>x^2 [[y]]</math> b <gallery>\nFile:a.jpg|[[c]]\n</gallery>d", "a  b d"),
    ("a <ref name=\"x\">kept</ref> b", "a kept b"),
    ("{|class=\"wikitable\"\n|+ style=\"x\" | Title\n! scope=\"col\" | A !! B\n|-\n| 1 || style=\"y\" | [[Dog|dogs]]\n| 2 !! 3\n|}", " Title\n A   B\n\n 1   dogs\n 2 !! 3\n"),
    ("before\n{|\n|a\n{| inner\n|b||c\n|}\n|d\n|}\nafter", "before\na\nb c\n\nd\n\nafter"),
    ("{|\n| [[File:x.jpg|thumb|cap]] || e\nmore text\n|}", " thumb|cap   e\nmore text\n"),
    (":{|\n|x\n|}", ":x\n"),
    ("{| never closed\n|x", "{| never closed\n|x"),
    ("a\n|} closes nothing", "a\n|} closes nothing"),
    ("f {|x|} g", "f {|x|} g"),
    ("{{t|\n{|\n|gone\n|}\n}}left", "left"),
    ("{|\n| {{t|a||b}} c\n|}", "  c\n"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("case", range(len(BLOCKS)))
def test_block_markup(spark, case):
    text, shown = BLOCKS[case]
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(strip_markup(F.col("text"))).first()[0] == shown


def test_headings_and_links_within_verbatim_text(spark):
    text = "lead [[A]] <nowiki>\n== no ==\n[[B]]\n</nowiki>\n== <nowiki>=</nowiki> sign ==\n<pre>== x ==</pre> [[C|c]] <!-- [[D]] -->"
    df = spark.createDataFrame([(text,)], "text string")
    row = extract_sections(df).first()
    assert row.headings == ["Lead", "= sign"]
    assert row.sections == ["lead A \n== no ==\n[[B]]", "== x == c"]
    for use, links in (("target", ["A", "C"]), ("display", ["A", "c"])):
        assert df.select(extract_links(F.col("text"), use)).first()[0] == links
