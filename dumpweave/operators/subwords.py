"""Sub-word lengths of texts: the longest pieces of a given vocabulary, taken from the left.

A word is cut into the longest piece that starts it, then the longest one that
goes on, and so forth. A word that cannot be cut to its end is one unknown
token. Every distinct word is cut once: its stretches are looked up in the
vocabulary, by a join, and the longest found at each place are walked through.
What a word comes to is then joined to the texts that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.fixed_values import CONTINUATION, LONGEST_WORD, SPECIAL_TOKENS
from dumpweave.plans.barrier import once
from dumpweave.plans.session import store


def read_vocabulary(spark: SparkSession, path: str, continuation: str = CONTINUATION) -> DataFrame:
    """``piece, is_start`` of a vocabulary file with a piece in each line.

    Pieces that go on within a word bear the mark of ``continuation``. With an
    empty mark all pieces may stand in both places.
    """
    return mark_pieces(spark.read.text(path).select(F.col("value").alias("piece")), continuation)


def mark_pieces(pieces: DataFrame, continuation: str = CONTINUATION) -> DataFrame:
    """``piece, is_start`` of ``piece`` as vocabularies write it; see ``read_vocabulary``."""
    pieces = pieces.where(F.col("piece").isNotNull() & (F.col("piece") != ""))
    if not continuation:
        return pieces.select("piece", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_start")).distinct()
    goes_on = F.startswith("piece", F.lit(continuation)) & (F.length("piece") > len(continuation))
    piece = F.when(goes_on, F.substring("piece", F.lit(len(continuation) + 1), F.length("piece"))).otherwise(F.col("piece"))
    return pieces.select(piece.alias("piece"), (~goes_on).alias("is_start")).distinct()


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, and single other characters that are not white space."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


def cut_words(words: DataFrame, vocabulary: DataFrame, longest_word: int = LONGEST_WORD) -> DataFrame:
    """``word, n_pieces, is_unknown`` of every distinct ``word``, NULL and empty ones left out.

    ``vocabulary`` has ``piece, is_start``. A word with more than
    ``longest_word`` characters is unknown, which also bounds its stretches.
    """
    distinct = words.select("word").where("word <> ''").distinct()
    distinct = store(distinct)
    pieces = store(vocabulary.where("piece <> ''").select("piece", "is_start").distinct())
    longest = pieces.agg(F.coalesce(F.max(F.length("piece")), F.lit(0)).alias("longest"))
    places = distinct.where(F.length("word") <= longest_word).select(
        "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    )
    longest = F.least(longest.scalar(), F.length("word") - F.col("at") + 1)
    stretches = places.where(longest > 0).select("word", "at", F.explode(F.sequence(F.lit(1), longest)).alias("size"))
    stretches = stretches.select(
        "word", "at", "size", F.substring("word", F.col("at"), F.col("size")).alias("piece"), (F.col("at") == 1).alias("is_start")
    )
    found = stretches.join(pieces, ["piece", "is_start"]).groupBy("word", "at").agg(F.max("size").alias("size"))
    # at most an entry for each character of a word
    steps = found.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("steps"))
    size = lambda at: F.coalesce(F.try_element_at("steps", at), F.lit(0))
    begin = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.length("word")),
        begin,
        lambda state, i: F.when(
            (state["at"] == i) & (size(i) > 0), F.struct((i + size(i)).alias("at"), (state["n"] + 1).alias("n"))
        ).otherwise(state),
    )
    walked = once(steps, end=end)
    whole = walked.where(F.col("end.at") > F.length("word")).select("word", F.col("end.n").alias("n"))
    return distinct.join(whole, "word", "left").select(
        "word", F.coalesce("n", F.lit(1)).alias("n_pieces"), F.col("n").isNull().alias("is_unknown")
    )


def subword_lengths(
    texts: DataFrame, vocabulary: DataFrame, key: str, cap: int | None = None, longest_word: int = LONGEST_WORD
) -> DataFrame:
    """``key, length, n_unknown`` of ``texts`` (key, text): sub-word tokens with the special ones.

    A NULL text has length 0. With a ``cap``, tokens beyond it, special ones
    counted, are cut off, the last of a word's pieces too; unknown words count
    as far as they are left. ``key`` tells rows apart; a NULL key does as well.
    """
    rows = store(texts.select(F.col(key).alias("_key"), plain_words(F.col("text")).alias("_words")))
    if cap is None:
        held = rows.select("_key", F.explode("_words").alias("word")).groupBy("_key", "word").agg(F.count("*").alias("n"))
        cut = cut_words(held, vocabulary, longest_word)
        sums = held.join(cut, "word").groupBy("_key").agg(
            F.sum(F.col("n") * F.col("n_pieces")).alias("total"), F.sum(F.when(F.col("is_unknown"), F.col("n"))).alias("unknown")
        )
    else:
        held = rows.select("_key", F.posexplode("_words").alias("pos", "word"))
        cut = cut_words(held, vocabulary, longest_word)
        entry = F.struct("pos", "n_pieces", "is_unknown")
        # a text's own words
        ordered = held.join(cut, "word").groupBy("_key").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        zero = F.lit(0).cast("bigint")
        room = cap - SPECIAL_TOKENS
        state = F.aggregate(
            "entries",
            F.struct(zero.alias("total"), zero.alias("unknown")),
            lambda s, e: F.struct(
                F.least(s["total"] + e["n_pieces"], F.lit(room)).alias("total"),
                (s["unknown"] + F.when(e["is_unknown"] & (s["total"] < room), 1).otherwise(0)).alias("unknown"),
            ),
        )
        sums = once(ordered, s=state).select("_key", "s.total", "s.unknown")
    sums = sums.withColumnRenamed("_key", "_of")
    joined = rows.join(sums, F.col("_key").eqNullSafe(F.col("_of")), "left")
    length = F.when(F.col("_words").isNotNull(), F.coalesce("total", F.lit(0)) + SPECIAL_TOKENS).otherwise(0)
    return joined.select(
        F.col("_key").alias(key), length.cast("bigint").alias("length"), F.coalesce("unknown", F.lit(0)).cast("bigint").alias("n_unknown")
    )


def lead_subword_lengths(pages: DataFrame, vocabulary: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """``subword_lengths`` of the first of each page's ``sections``; 0 without a section."""
    return subword_lengths(pages.select(key, F.get("sections", F.lit(0)).alias("text")), vocabulary, key, cap)


def unknown_subword_share(lengths: DataFrame) -> DataFrame:
    """One row: unknown tokens of ``lengths`` (length, n_unknown), all tokens with the special ones, and the percentage."""
    total = lengths.agg(
        F.coalesce(F.sum("n_unknown"), F.lit(0)).alias("n_unknown"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens")
    )
    return total.withColumn("percent_unknown", 100 * F.col("n_unknown") / F.nullif("n_tokens", F.lit(0)))
