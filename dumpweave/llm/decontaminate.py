"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of all benchmark items are normalised, hashed and broadcast in
blocks of a fixed size; a benchmark beyond one block takes one scan for each.
Every word window of every document is looked up. A hit is verified word by word
against the item's window before it counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import aside, map_batches
from dumpweave.plans.session import store

WINDOW = 10
# bytes of benchmark text in one broadcast; the windows take about 20 times that
BLOCK_BYTES = 16 << 20


class Windows:
    """Normalised windows of benchmark items: by their length, hash to text and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        found: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = normalised_words(text or "")
            k = min(size, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                found[k][b" ".join(words[i : i + k])].add(item)
        self.by_length = {}
        for k, texts in found.items():
            joined = list(texts)
            data, offsets = K.utf8(pa.array(x.decode("utf-8", "surrogateescape") for x in joined))
            starts, ends, _ = K.word_spans(data, offsets, K.ALPHANUMERIC)
            hashes = K.windows(K.span_hash(K.running_hash(data), starts, ends), k)[::k]
            self.by_length[k] = (hashes, joined, [sorted(texts[x] - {None}) for x in joined])

    def index(self) -> dict[int, tuple[K.HashIndex, list[bytes], list[list[str]]]]:
        return {k: (K.HashIndex(h), texts, items) for k, (h, texts, items) in self.by_length.items()}


def normalised_words(text: str) -> list[bytes]:
    data = K.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    starts, ends, _ = K.word_spans(data, np.array([0, len(data)]), K.ALPHANUMERIC)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _scan(batch: pa.RecordBatch, index: dict, column: str) -> Iterator[dict]:
    """The rows with the hits of these windows added to those of earlier blocks."""
    for part, data, offsets in K.chunks(batch, column):
        lower = K.LOWER[data]
        starts, ends, first = K.word_spans(lower, offsets, K.ALPHANUMERIC)
        words = K.span_hash(K.running_hash(lower), starts, ends)
        owner = K.owners(first)
        raw = lower.tobytes()
        change = np.zeros(len(words) + 1, dtype=np.int32)
        items = [set(x or ()) for x in part.column("_items").to_pylist()]
        for k, (known, texts, names) in index.items():
            place = known.find(K.windows(words, k))
            at = np.flatnonzero(place >= 0)
            at = at[owner[at] == owner[at + k - 1]]
            for i, window in zip(at.tolist(), place[at].tolist(), strict=True):
                here = b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + k))
                if here == texts[window]:
                    change[i] += 1
                    change[i + k] -= 1
                    items[owner[i]].update(names[window])
        hit = np.cumsum(change[:-1]) > 0
        spans = []
        for row, (lo, hi, earlier) in enumerate(
            zip(first[:-1].tolist(), first[1:].tolist(), part.column("_spans").to_pylist(), strict=True)
        ):
            for span in earlier or ():
                hit[lo + span["first"] : lo + span["first"] + span["words"]] = True
            edge = np.flatnonzero(np.diff(hit[lo:hi], prepend=False, append=False))
            spans.append(
                [
                    {
                        "first": s,
                        "words": e - s,
                        "start": int(starts[lo + s] - offsets[row]),
                        "end": int(ends[lo + e - 1] - offsets[row]),
                    }
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
                ]
            )
        columns = {c: part.column(c) for c in part.schema.names}
        yield columns | {
            "n_words": np.diff(first),
            "_items": [sorted(x) for x in items],
            "_spans": spans,
        }


SPANS = "array<struct<first:int,words:int,start:int,end:int>>"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with four more columns.

    ``n_words`` (int), ``hit_spans`` (word number, words, and start and end in
    bytes of each maximal run of hit words), ``hit_items`` (ids, as strings,
    of the items with a window that occurs) and ``n_hit`` (long).

    Words are runs of ASCII letters, digits and other than ASCII characters,
    A-Z lower-cased. A window is ``size`` words in a row of an item (item_id,
    text); an item of fewer, but not none, is one window. A null or empty text
    has no words. Rows of the benchmark that share an item_id are one item; one
    without an item_id marks words but is not listed. Repeated rows of ``docs``
    stay, each with its hits. ``docs`` must not have the four columns itself.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    found = docs.withColumns(
        {
            "n_words": F.lit(0),
            "_items": F.array().cast("array<string>"),
            "_spans": F.array().cast(SPANS),
        }
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    for block in range(blocks):
        # a block holds whole items; the hash deals them out evenly
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()], size))
        cache: dict = {}

        def scan(batch: pa.RecordBatch, windows=windows, cache=cache) -> Iterator[dict]:
            if not cache:
                cache["index"] = windows.value.index()
            yield from _scan(batch, cache["index"], column)

        found = map_batches(found, scan, schema)
        if block + 1 < blocks:
            found = store(found)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumnRenamed("_items", "hit_items")
        .withColumnRenamed("_spans", "hit_spans")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words, hit words and items, as counts and a digest.

    The digest is the SHA-256 of the item ids, sorted as strings and joined by
    commas; of the empty string if there is none.
    """
    found = find_contamination(docs.select("doc_id", "text"), benchmark, size)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs; columns as they were."""
    own, back = aside(docs, "text")
    return back(find_contamination(own, benchmark, size).where("n_hit = 0"))


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All rows of ``docs``, with the hit words cut out of ``text``; a null text stays null."""
    own, back = aside(docs, "text")
    found = find_contamination(own, benchmark, size)
    raw = F.col("text").cast("binary")
    # what lies between the end of one span and the start of the next
    starts = F.concat(F.array(F.lit(0)), F.col("hit_spans.end"))
    ends = F.concat(F.col("hit_spans.start"), F.array(F.octet_length("text")))
    kept = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda x: F.substring(raw, x["s"] + 1, x["e"] - x["s"]),
    )
    text = F.aggregate(kept, F.lit(b""), lambda whole, piece: F.concat(whole, piece)).cast("string")
    return back(found.withColumn("text", F.when(F.size("hit_spans") > 0, text).otherwise(F.col("text"))))
