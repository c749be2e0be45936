"""Token-id files: canonical length-limited Huffman code, in independent blocks.

Ids are counted over the whole corpus; one canonical code, no longer than
``LONGEST`` bits, is built from the counts. Documents are sorted by doc_id and
written in files, one for each run of sorted rows that a task reads. A file is
a row of blocks:

    magic "TIDS", version, bytes of the packed table
    packed table (zlib): per document doc_id, whether it is null, and its number
        of ids; ids before the block in this file; the place in bits of every
        ``EVERY``-th id, relative to the block's first bit
    the coded ids, filled up to 32 bits

A block holds whole documents and is read without any other. Its checkpoints
let all stretches of ``EVERY`` ids be decoded side by side by table look-up.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import map_partition, open_input, open_output, small_table, text_key
from dumpweave.llm.pretokens import encoder
from dumpweave.plans.session import discard, store, work_dir

MAGIC, VERSION = b"TIDS", 1
LONGEST = 18
EVERY = 256
BLOCK_IDS = 1 << 20
# coded bytes that a task reads back
READ_BYTES = 16 << 20


# --- the code -------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Length of each id's code word, 0 for an id that does not occur (package-merge)."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, single = weights, []
    for _ in range(longest - 1):
        single.append(np.ones(len(merged), dtype=bool) if not single else single_now)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged, single_now = both[rank], rank < len(weights)
    single.append(single_now if longest > 1 else np.ones(len(weights), dtype=bool))
    take = 2 * len(weights) - 2
    depth = np.zeros(len(weights) + 1, dtype=np.int64)
    for level in reversed(single):
        own = int(level[:take].sum())
        depth[own] += 1
        take = 2 * (take - own)
    # the first ``own`` ids of each level get one bit more
    lengths[order] = np.cumsum(depth[::-1])[::-1][1:]
    return lengths


@dataclass
class Code:
    """A canonical code: words in the order of (length, id)."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.longest = int(self.lengths.max(initial=1))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        size = self.lengths[order].astype(np.int64)
        # words as the leading bits of ``longest`` bits: each takes its share of the table
        span = np.left_shift(1, self.longest - size)
        start = np.cumsum(span) - span
        self.words = np.zeros(len(self.lengths), dtype=np.uint64)
        self.words[order] = (start >> (self.longest - size)).astype(np.uint64)
        self.ids = np.zeros(1 << self.longest, dtype=np.uint32)
        filled = np.repeat(order, span)
        self.ids[: len(filled)] = filled
        self.sizes = np.ones(1 << self.longest, dtype=np.uint8)
        self.sizes[: len(filled)] = self.lengths[filled]

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coded ids in 32-bit words, and the place in bits of every ``EVERY``-th id."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(end) else 0
        out = np.zeros(total // 32 + 2, dtype=np.uint64)
        if len(ids):
            # a word lies in two neighbouring 32-bit words at most
            shift = (64 - size - (at & 31)).astype(np.uint64)
            both = self.words[ids] << shift
            place = at >> 5
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            out[place[first]] += np.add.reduceat(both >> np.uint64(32), first)
            out[place[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
        return out[: -(-total // 32)].astype(">u4"), at[::EVERY]

    def decode(self, words: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids; the stretches that start at ``places`` go side by side."""
        wide = np.zeros(len(words) + 3, dtype=np.uint64)
        wide[: len(words)] = words
        # at each 32-bit word the 64 bits from there on
        wide[:-1] = wide[:-1] << np.uint64(32) | wide[1:]
        out = np.zeros((EVERY, len(places)), dtype=np.uint32)
        at = places.astype(np.int64)
        full = n - (len(places) - 1) * EVERY
        keep = np.uint64((1 << self.longest) - 1)
        last = np.uint64(64 - self.longest)
        for i in range(EVERY if len(places) > 1 else full):
            if i == full:  # the last stretch is shorter
                at = at[:-1]
            peek = wide[at >> 5] >> (last - (at & 31).astype(np.uint64)) & keep
            out[i, : len(at)] = self.ids[peek]
            at += self.sizes[peek]
        return out.T.ravel()[:n]


# --- blocks ---------------------------------------------------------------------------


def pack_block(code: Code, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    words, places = code.encode(ids)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    known = np.array([d or 0 for d in doc_ids], dtype="<i8")
    table = zlib.compress(
        struct.pack("<qqq", len(doc_ids), len(ids), before)
        + known.tobytes()
        + null.tobytes()
        + sizes.astype("<i8").tobytes()
        + places.astype("<i8").tobytes(),
        6,
    )
    return MAGIC + struct.pack("<II", VERSION, len(table)) + table + words.tobytes()


def unpack_block(code: Code, raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, numbers of ids, the ids, and the ids before the block in its file."""
    version, length = struct.unpack_from("<II", raw, 4)
    if raw[:4] != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    table = zlib.decompress(raw[12 : 12 + length])
    docs, n, before = struct.unpack_from("<qqq", table)
    at = 24
    parts = []
    for count, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<i8"), (-(-n // EVERY), "<i8")):
        parts.append(np.frombuffer(table, dtype=kind, count=count, offset=at))
        at += parts[-1].nbytes
    known, null, sizes, places = parts
    words = np.frombuffer(raw, dtype=">u4", offset=12 + length).astype(np.uint64)
    ids = code.decode(words, places, n) if n else np.zeros(0, dtype=np.uint32)
    doc_ids = [None if x else d for d, x in zip(known.tolist(), null.tolist(), strict=True)]
    return doc_ids, sizes, ids, before


# --- tables to files and back -----------------------------------------------------------


def encoded_texts(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids, place) of every row: the ids of its text and the end id in one binary; rows are stored in their order.

    Encoding is most of the work, so each text is encoded once and its ids are
    stored, from which they are counted and then written. Texts are sorted
    before they are encoded: what that shuffles is gone once the ids are stored,
    and equal texts of a doc_id lie side by side, where they compress. ``place``
    grows in the order of doc_id and of a digest of the text, by 1 from row to
    row of a sorted partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for part, data, offsets in K.chunks(batch):
                ids, bounds = bpe.encode(data, offsets)
                raw = np.insert(ids, bounds[1:], end_id).astype(kind)
                ends = (bounds + np.arange(len(bounds))) * raw.itemsize
                buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]
                yield {
                    "doc_id": part.column("doc_id"),
                    "ids": pa.Array.from_buffers(pa.large_binary(), part.num_rows, buffers),
                }

    keyed = docs.withColumn("key", F.unhex(text_key(F.col("text"))))
    # by the digest too, so that rows that share a doc_id, as null, need not go to one task
    ordered = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").drop("key")
    encoded = map_partition(ordered, run, "doc_id long, ids binary")
    return store(encoded.withColumn("place", F.monotonically_increasing_id()), compression="zstd")


def stored_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in a row, and ``n + 1`` bounds."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, (ends - ends[0]) // data.itemsize


def id_counts(encoded: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """How often each id occurs; one row for each id and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            total += np.bincount(stored_ids(batch.column("ids"), kind)[0], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield {"id": used, "n": total[used]}

    counted = map_partition(encoded.select("ids"), count, "id int, n long")
    total = np.zeros(vocabulary, dtype=np.int64)
    # as many rows as the vocabulary has ids
    for row in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row["id"]] = row["n"]
    return total


class FileWriter:
    """One file of sorted documents; ``close`` gives its part of the catalogue."""

    def __init__(self, code: Code, folder: str, place: int):
        self.code, self.place = code, place
        self.path = f"{folder}/ids-{place:019d}-{uuid.uuid4().hex}.ids"
        self.out = open_output(self.path)
        self.offset = self.before = self.waiting = 0
        self.entries, self.doc_ids, self.pending = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        sizes = np.array([len(x) for x in self.pending])
        raw = pack_block(self.code, self.doc_ids, sizes, np.concatenate(self.pending), self.before)
        self.out.write(raw)
        self.entries.append((len(self.entries), self.offset, len(raw), self.waiting))
        self.offset, self.before, self.waiting = self.offset + len(raw), self.before + self.waiting, 0
        self.doc_ids.clear()
        self.pending.clear()

    def close(self) -> dict:
        if self.pending:
            self.flush()
        self.out.close()
        block, offsets, sizes, n_ids = zip(*self.entries, strict=True)
        return {
            "place": [self.place] * len(self.entries),
            "file": [self.path] * len(self.entries),
            "block": list(block),
            "offset": list(offsets),
            "length": list(sizes),
            "n_ids": list(n_ids),
        }


def write_files(encoded: DataFrame, code: Code, folder: str, kind: str) -> DataFrame:
    """Write the files; returns the catalogue (place, file, block, offset, length, n_ids) of their blocks.

    ``place`` is that of the file's first row. Nothing is shuffled: ``encoded``
    lies in order, and however its files are cut or put together for a task, a
    file ends where the next row is not the one that follows.

    Each attempt of a task writes files of its own names, and only those of the
    attempt that counted are in the catalogue; others are left unread.
    """
    lengths = code.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, writer, follows = Code(lengths), None, None
        try:
            for batch in batches:
                ids, bounds = stored_ids(batch.column("ids"), kind)
                rows = zip(batch.column("doc_id").to_pylist(), batch.column("place").to_pylist(), strict=True)
                for i, (doc_id, place) in enumerate(rows):
                    if place != follows:
                        if writer:
                            yield writer.close()
                        writer = FileWriter(own, folder, place)
                    writer.add(doc_id, ids[bounds[i] : bounds[i + 1]])
                    follows = place + 1
            if writer:
                yield writer.close()
        finally:
            if writer:
                writer.out.close()

    schema = "place long, file string, block int, offset long, length long, n_ids long"
    return store(map_partition(encoded, run, schema))


def read_files(catalogue: DataFrame, code: Code) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Blocks are dealt out to tasks and read by range. ``start`` counts the ids of
    all documents before: those of earlier files, known from the catalogue with
    one row for each file, and those before in the file.
    """
    spark = catalogue.sparkSession
    files = catalogue.groupBy("place").agg(F.sum("n_ids").alias("n")).orderBy("place").collect()
    sizes = np.array([row["n"] for row in files], dtype=np.int64)
    columns = {"place": [row["place"] for row in files], "begin": np.cumsum(sizes) - sizes}
    begin = small_table(spark, columns, "place long, begin long")
    lengths = code.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Code(lengths)
        for batch in batches:
            for entry in batch.to_pylist():
                with open_input(entry["file"]) as source:
                    raw = source.read_at(entry["length"], entry["offset"])
                doc_ids, sizes, ids, before = unpack_block(own, raw)
                ends = np.cumsum(sizes)
                flat = memoryview(ids.astype("<u4").tobytes())
                bounds = (np.append(0, ends) * 4).tolist()
                yield {
                    "doc_id": doc_ids,
                    "start": entry["begin"] + before + ends - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                }

    # one row for each file: their number is that of the sorted partitions, or of the splits they are read by
    dealt = catalogue.join(F.broadcast(begin), "place")
    # rows are tiny and stand for whole blocks, so their bytes set the number of tasks
    tasks = (catalogue.agg(F.sum("length")).first()[0] or 0) // READ_BYTES + 1
    dealt = dealt.repartition(tasks, "file", "block")
    return map_partition(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token-id files and report on what the files hold.

    One row for each row of ``docs``: doc_id, start, n_tokens (with the end id)
    and ids_crc32. A null or empty text has the end id only. Rows are in the
    order of doc_id, null first; rows that share one in the order of a digest of
    their texts. Other columns are left out. An empty table writes no file and
    gives no rows. The tokenizer's file must be there on every executor.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids of a vocabulary of up to 65,536 take two bytes
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    encoded = encoded_texts(docs, tokenizer, end_id, kind)
    code = Code(code_lengths(id_counts(encoded, kind, vocabulary)))
    folder = folder or work_dir(docs.sparkSession, "tokens")
    catalogue = write_files(encoded, code, folder, kind)
    discard(encoded)
    return read_files(catalogue, code)
