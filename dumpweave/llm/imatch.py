"""Document fingerprints by I-Match with randomised lexicons, in DataFrame operations only.

The lexicon holds the terms whose inverse document frequency lies in a band.
Several random subsets of it are drawn, dense and sparse ones. The part of a
fingerprint that belongs to a subset is a hash of the document's distinct terms
in that subset, in sorted order. Two documents are as alike as the share of
subsets, with terms of either, in which their parts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.llm.frames import text_key
from dumpweave.plans.ordered import global_index
from dumpweave.plans.session import discard, store

# log2(documents / documents with the term). The number of terms below the upper
# end is at most 2 ** IDF_MOST times the mean number of terms in a document,
# however many documents there are: this bounds what is broadcast.
IDF_LEAST, IDF_MOST = 4.0, 10.0
# one subset for each: it takes a term in 2 ** density
DENSITIES = (3, 4, 5, 5, 6, 6, 6, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8, 8, 9, 9, 9, 9, 9, 9)
EMPTY = "0" * 8


def terms(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and all beyond ASCII, lower-cased, and the empty string.

    Every text has the empty string.
    """
    found = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def lexicon(docs: DataFrame, least: float = IDF_LEAST, most: float = IDF_MOST) -> DataFrame:
    """(id, subsets) of the terms of ``docs`` (text) in the band, with a bit for each subset they are in.

    The empty string is there with no subset.
    """
    ids = docs.select(F.explode(terms(F.col("text"))).alias("term")).select(F.xxhash64("term").alias("id"))
    empty = F.col("id") == F.xxhash64(F.lit(""))
    # every document holds the empty string: its frequency is their number
    frequency = ids.groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).cast("double")).first()[0]
    idf = F.log2(F.lit(total) / F.col("df"))
    subsets = F.lit(0)
    for i, density in enumerate(DENSITIES):
        inside = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << density)) == 0
        subsets = subsets + F.when(inside, F.lit(1 << i)).otherwise(F.lit(0))
    subsets = F.when(empty, F.lit(0)).otherwise(subsets)
    chosen = frequency.select("id", empty.alias("empty"), subsets.alias("subsets"), idf.between(least, most).alias("band"))
    return chosen.where("empty or (band and subsets > 0)").select("id", "subsets")


def fingerprints(texts: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """``keys`` and ``parts``, one hash for each subset, of the rows of ``texts`` (keys, text).

    Rows with equal keys must have equal texts; they give one row. A subset
    without terms of the text has the part ``EMPTY``. A text without any term of
    the subsets is known by a hash of itself.
    """
    rows = texts.select(*keys, F.explode(terms(F.col("text"))).alias("term"))
    found = rows.select(*keys, F.xxhash64("term").alias("id")).join(F.broadcast(words), "id")
    entry = F.when(F.col("subsets") > 0, F.struct("id", "subsets"))
    # a text's terms: its own length bounds them
    grouped = found.groupBy(*keys).agg(F.sort_array(F.collect_set(entry)).alias("terms"))
    bits = F.array(*[F.lit(1 << i) for i in range(len(DENSITIES))])
    inside = F.transform(bits, lambda bit: F.filter("terms", lambda t: t["subsets"].bitwiseAND(bit) > 0))
    parts = F.transform(
        inside, lambda own: F.when(F.size(own) == 0, F.lit(EMPTY)).otherwise(short_hash(F.xxhash64(own["id"])))
    )
    return grouped.select(*keys, F.when(F.size("terms") > 0, parts).alias("parts"))


def short_hash(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def own_parts(parts: Column, key: Column) -> Column:
    """``parts``, or for a text without terms of the subsets a hash of its name everywhere."""
    return F.coalesce(parts, F.array_repeat(short_hash(F.xxhash64(key)), len(DENSITIES)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with terms of either text in which the parts agree."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    told = F.filter(both, lambda x: (x["a"] != EMPTY) | (x["b"] != EMPTY))
    same = F.filter(told, lambda x: x["a"] == x["b"])
    return F.size(same) / F.greatest(F.size(told), F.lit(1)).cast("double")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    In the edited text the last third of the code points (rounded down) is
    replaced by as many of the first ones of the next document, or all it has.
    Next is the row of the next smaller doc_id; after the smallest, and rows
    without doc_id, comes the largest. Rows that share a doc_id are in the order
    of a digest of their texts. A null text is an empty one.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Other columns are left out. An empty table gives no
    rows; the next document of a single row is itself.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("key", F.unhex(text_key(F.col("text"))))
    words = store(lexicon(docs.select("text")))
    narrow = docs.select("doc_id", "key", F.length("text").cast("long").alias("n_chars"))
    ordered = store(global_index(narrow, [F.desc_nulls_last("doc_id"), F.asc("key")], "place"))
    rows = ordered.count()
    following = ordered.select(
        F.pmod(F.col("place") - 1, F.lit(max(rows, 1))).alias("place"), F.col("key").alias("next_key")
    )
    pairs = store(ordered.join(following, "place"))
    discard(ordered)
    # texts once each; copies meet in the map tasks first
    texts = docs.groupBy("key").agg(F.first("text").alias("text"))
    heads = pairs.join(texts.withColumnRenamed("key", "next_key"), "next_key").select(
        "place", "key", "n_chars", F.expr("left(text, int(n_chars div 3))").alias("head")
    )
    edited = heads.join(texts, "key").select(
        "place", F.concat(F.expr("left(text, int(n_chars - n_chars div 3))"), F.col("head")).alias("text")
    )
    edited = edited.withColumns({"edited_sha256": F.sha2(F.col("text").cast("binary"), 256), "edited_key": F.unhex(text_key(F.col("text")))})
    changed = fingerprints(edited, ["place", "edited_sha256", "edited_key"], words)
    # from the rows as they are: what is moved is a text's terms of the lexicon, not the text
    own = store(fingerprints(docs.select("key", "text"), ["key"], words))
    found = (
        pairs.join(changed.withColumnRenamed("parts", "changed"), "place")
        .join(own, "key")
        .join(own.select(F.col("key").alias("next_key"), F.col("parts").alias("next_parts")), "next_key")
    )
    found = found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        own_parts(F.col("parts"), F.col("key")).alias("own"),
        own_parts(F.col("changed"), F.col("edited_key")).alias("changed"),
        own_parts(F.col("next_parts"), F.col("next_key")).alias("next"),
    )
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat_ws("", "own").alias("fingerprint"),
        F.concat_ws("", "changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
