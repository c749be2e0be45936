"""TF-IDF vectors in long form, and cosine similarity of given pairs or of all above a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dumpweave.functions.text import remove_stopwords, tokenize_terms
from dumpweave.operators import packs
from dumpweave.plans.session import store
from dumpweave.plans.skew import top_per_key

#: Documents whose distinct terms ask for their frequencies together.
BLOCK_DOCS = 500
#: Blocks of a task, on average.
PART_BLOCKS = 3
#: Pairs that a task works out.
TASK_PAIRS = 2_000


def normalised_corpus(docs: DataFrame, **options) -> DataFrame:
    """Documents with stop words removed."""
    return docs.withColumn("text", remove_stopwords(F.col("text"), **options))


def tfidf(docs: DataFrame, packed: bool = False) -> DataFrame:
    """``doc, term, tf, weight`` for ``doc, text``; no zero entries.

    weight = tf * (ln((1 + n) / (1 + df)) + 1), divided by the document's
    Euclidean norm. n counts all documents, those without any term as well.
    Documents are dealt out in blocks, and their terms lie where their block
    does. Only a block's distinct terms meet those of others, one row each, and
    come back with the whole frequency; a document's terms are never shuffled
    one by one. With ``packed`` the same has some thousand documents to a row
    (see ``packs.packed``), a fraction as large, for ``similar_pairs`` and
    ``vector_classes``.
    """
    if packed:
        return packs.packed(docs)
    n_docs = docs.agg(F.count("*")).scalar()
    # never null, so that no filter tells the two uses apart
    blocks = docs.count() // BLOCK_DOCS + 1
    block = F.coalesce(F.pmod(F.xxhash64("doc"), F.lit(blocks)), F.lit(0))
    parts = blocks // PART_BLOCKS + 1
    dealt = docs.select(block.alias("_block"), "doc", tokenize_terms(F.col("text")).alias("_terms"))
    dealt = dealt.repartition(parts, "_block")
    # both uses read doc as well, so that they share the shuffle
    terms = dealt.groupBy("_block", "doc").agg(F.flatten(F.collect_list("_terms")).alias("_terms"))
    held = terms.select("_block", F.explode(F.array_distinct("_terms")).alias("term"))
    held = held.groupBy("_block", "term").agg(F.count("*").alias("_n"))
    frequency = F.sum("_n").over(Window.partitionBy("term"))
    idf = held.select("_block", "term", (F.log((1 + n_docs) / (1 + frequency)) + 1).alias("idf"))
    counts = terms.select("_block", "doc", F.explode("_terms").alias("term"))
    counts = counts.groupBy("_block", "doc", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(idf.repartition(parts, "_block").hint("shuffle_hash"), ["_block", "term"])
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("_block", "doc")))
    return weighed.select("doc", "term", "tf", (raw / norm).alias("weight"))


def document_vectors(vectors: DataFrame) -> DataFrame:
    """``doc, weights``: the entries of every document as a map from term to weight."""
    entries = F.map_from_entries(F.collect_list(F.struct("term", "weight")))
    return vectors.groupBy("doc").agg(entries.alias("weights"))


def pairwise_cosine(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, similarity`` for the pairs given; 0 where no term is shared.

    A pair that is given more than once has one row. Nothing is paired up that
    was not asked for. Every document's entries are one row, so the two joins
    move pairs and not their terms, and a pair is worked out where it lies.
    """
    return _cosine(document_vectors(vectors), pairs)


def _cosine(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    # small rows and much work each: dealt out by their number, not by their size
    pairs = store(pairs.select("a", "b").distinct())
    pairs = pairs.repartition(pairs.count() // TASK_PAIRS + 1, "a")
    left = documents.select(F.col("doc").alias("a"), F.col("weights").alias("_wa"))
    right = documents.select(F.col("doc").alias("b"), F.col("weights").alias("_wb"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    products = F.map_values(F.map_zip_with("_wa", "_wb", lambda _, x, y: x * y))
    dot = F.aggregate(products, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))
    return both.select("a", "b", F.coalesce(dot, F.lit(0.0)).alias("similarity"))


def _is_packed(vectors: DataFrame) -> bool:
    return "numbers" in vectors.columns


def _packed_classes(vectors: DataFrame) -> DataFrame:
    """``pack, pos, doc, representative`` of every document with terms."""
    named = packs.named(vectors)
    first = named.groupBy("name").agg(F.min("doc").alias("representative"))
    return named.join(first, "name").select("pack", "pos", "doc", "representative")


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``doc, representative`` of every document with terms: the least one that has the same terms as often."""
    if _is_packed(vectors):
        return _packed_classes(vectors).select("doc", "representative")
    entry = F.concat("term", F.lit("\x01"), F.col("tf").cast("string"))
    held = vectors.groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("_held"))
    named = held.select("doc", F.sha2(F.array_join("_held", "\x02").cast("binary"), 256).alias("_name"))
    first = named.groupBy("_name").agg(F.min("doc").alias("representative"))
    return named.join(first, "_name").select("doc", "representative")


def prefix_candidates(vectors: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b), the pairs of documents that may have a cosine of ``threshold`` or more.

    A document's terms are in order from rare to frequent. Common terms of two
    documents start with one they meet at first; from there on, what is left of
    either vector bounds their product. So a term is listed only while what is
    left, itself included, is as long as the threshold. Frequent terms stand at
    the end and are mostly not listed. Documents that share listed terms are
    many where texts are long; so the products of these terms are summed, and
    only pairs stay that can still reach the threshold with what is left of both.
    """
    kind = vectors.schema["doc"].dataType.simpleString()
    return packs.pairs_of_files(packs.files_of_rows(vectors), kind, threshold, exact=False).select("a", "b")


def similar_pairs(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All pairs of documents with a cosine of ``threshold`` or more, without comparing all pairs.

    Returns ``a, b, similarity`` (a < b) between representatives, and ``doc,
    representative`` of every document; documents with one representative are
    equal, and their pairs are not spelled out. ``vectors`` are of length 1, as
    ``tfidf`` gives them, and best packed; else (doc, term, tf, weight), which
    are read several times, so pass a stored table. The threshold is above 0.

    Candidates are found as in ``prefix_candidates`` and worked out where they
    are found, as both vectors lie there (see ``packs.pairs_of_files``).
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not above 0 and at most 1")
    if _is_packed(vectors):
        classes = store(_packed_classes(vectors))
        files = packs.files_of_packs(vectors, classes.where("not coalesce(doc = representative, false)"))
        kind = vectors.schema["docs"].dataType.elementType.simpleString()
    else:
        classes = store(vector_classes(vectors))
        chosen = classes.where("doc = representative").select("doc")
        files = packs.files_of_rows(vectors.select("doc", "term", "weight").join(chosen, "doc", "left_semi"))
        kind = vectors.schema["doc"].dataType.simpleString()
    return packs.pairs_of_files(files, kind, threshold), classes.select("doc", "representative")


def similar_pages(
    links: DataFrame, vectors: DataFrame, threshold: float = 0.0, k: int | None = None
) -> DataFrame:
    """Links ``src, dst`` whose pages are similar enough, the ``k`` best per page.

    Copies of a link and links to oneself count once and not at all.
    """
    pairs = links.where(F.col("src") != F.col("dst")).select(
        F.col("src").alias("a"), F.col("dst").alias("b")
    )
    scored = (
        pairwise_cosine(vectors, pairs)
        .where(F.col("similarity") >= threshold)
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity")
    )
    if k is None:
        return scored
    return top_per_key(scored, ["src"], [F.col("similarity").desc(), F.col("dst")], k, ["dst"])


def melt_terms(wide: DataFrame, terms: list[str], doc: str = "doc") -> DataFrame:
    """Long rows from a wide matrix, zero entries dropped."""
    return wide.unpivot(doc, terms, "term", "weight").where(F.col("weight") != 0)


def top_terms(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest terms of every document, ties by term."""
    return top_per_key(vectors, ["doc"], [F.col("weight").desc(), F.col("term")], k, ["term"])


def sort_terms(vectors: DataFrame) -> DataFrame:
    return vectors.orderBy("doc", F.col("weight").desc(), "term")
