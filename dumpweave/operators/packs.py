"""TF-IDF vectors in packs of documents, and all pairs of them above a cosine, worked out block against block.

A pack holds some thousand documents as arrays: its distinct terms once, and for
every document the places of its terms among them. Terms that two documents or
more hold are numbered from rare to frequent, over all packs.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dumpweave.functions.text import tokenize_terms
from dumpweave.plans.ordered import global_index
from dumpweave.plans.session import small_batches, store, work_dir, workers_find_library

#: Sums by which pairs are left out are exact to this.
SLACK = 1e-6
#: Words of a pack, and documents of it, at most; one long document may have more words.
PACK_WORDS = 1_400_000
PACK_DOCS = 16_384
#: Entries of a block and documents in it, at most, and how many blocks there are at least.
BLOCK_ENTRIES = 3_000_000
BLOCK_DOCS = 32_768
LEAST_BLOCKS = 6
#: Blocks that a task holds, and blocks that come against these one after the other.
HELD_BLOCKS = 2
TASK_BLOCKS = 8
#: Cells of a table of sums, products that are added to it at once, and products for each cell from which it pays.
CELLS = 1_000_000
PRODUCTS = 1_000_000
DENSE = 1 / 16
#: Share of a block's documents, the longest ones, that meet those of another block as matrices; for
#: terms that, on average, this share of their pairs both list, and so many terms at most.
HEAVY = 0.05
MATRIX = 0.0028
COLUMNS = 4_096
#: Pairs that are handed over at once.
TOLD = 100_000
#: Numbers of terms at which the length of what is left of a document is kept.
CUTS = 128


def give_back_memory() -> None:
    """Return freed memory to the system, as a worker stays while others run."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for columns in function(batch for batch in batches if batch.num_rows):
                held = [columns[f.name] for f in schema]
                arrays = [
                    x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                    for f, x in zip(schema, held, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            give_back_memory()

    workers_find_library(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _one(values: pa.Array | np.ndarray) -> pa.Array:
    """One row that holds all ``values`` as a list."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _joined(arrays: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(arrays) if len(arrays) != 1 else arrays[0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, one after the other."""
    found = np.arange(int(sizes.sum()))
    found += np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return found


# --- packs ----------------------------------------------------------------------
def _pack(number: int, docs: list[pa.Array], words: list[pa.Array]) -> dict:
    doc, listed = _joined(docs), _joined(words)
    lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    coded = listed.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    width = max(len(order), 1)
    key = np.repeat(np.arange(len(doc)) * width, lengths) + place[coded.indices.to_numpy()]
    key, tf = np.unique(key, return_counts=True)
    owner, code = key // width, key % width
    gaps = np.diff(code, prepend=0)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    gaps[first] = code[first]
    terms, sizes = coded.dictionary.take(pa.array(order)), np.bincount(owner, minlength=len(doc))
    return {
        "pack": [number],
        "docs": _one(doc),
        "sizes": _one(sizes),
        "names": _one(pa.array(_names(sizes, terms.take(pa.array(code)), tf), pa.binary())),
        "gaps": _one(gaps),
        "tf": _one(tf),
        "terms": _one(terms),
        "held": _one(np.bincount(code, minlength=len(order))),
    }


def _names(sizes: np.ndarray, terms: pa.Array, tf: np.ndarray) -> list[bytes]:
    """Digests that tell documents apart by their terms, which are in order, and how often they occur."""
    offsets, data = terms.buffers()[1:]
    ends = np.cumsum(sizes).tolist()
    if not len(terms):
        return [b""] * len(sizes)
    bounds = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    shape, data = np.stack([np.diff(bounds), tf], axis=1), memoryview(data)
    names = []
    for end, size in zip(ends, sizes.tolist(), strict=True):
        digest = hashlib.sha256(shape[end - size : end])
        digest.update(data[bounds[end - size] : bounds[end]])
        names.append(digest.digest())
    return names


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    number = TaskContext.get().partitionId() << 32
    docs, words, n_docs, n_words = [], [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, PACK_DOCS):
            part = batch.slice(at, PACK_DOCS)
            doc, listed = part.column("doc"), part.column("words")
            found = len(listed.flatten())
            if docs and (n_words + found > PACK_WORDS or n_docs + len(doc) > PACK_DOCS):
                yield _pack(number, docs, words)
                number, docs, words, n_docs, n_words = number + 1, [], [], 0, 0
            docs.append(doc)
            words.append(listed)
            n_docs, n_words = n_docs + len(doc), n_words + found
    if docs:
        yield _pack(number, docs, words)


def packed(docs: DataFrame) -> DataFrame:
    """TF-IDF of ``doc, text`` as packs, which are a stored table.

    ``docs`` are a pack's documents, ``sizes`` the number of their distinct terms
    and ``names`` what equal documents share. ``gaps`` and ``tf`` have an entry for each of these: how far it lies
    in ``terms`` behind the one before, and how often it occurs. ``numbers`` are
    (pos, id, df) of the ``terms`` that two documents or more hold, the others
    have a frequency of 1. ``n_docs`` counts all documents.

    Documents stay where they are read, unless one has several rows. Only the
    distinct terms of a pack meet those of others. ``numbers`` are joined to the
    packs where they are asked for, which moves only the columns in use.
    """
    rows = docs.select("doc", tokenize_terms(F.col("text")).alias("words"))
    if not docs.groupBy("doc").count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc").agg(F.flatten(F.collect_list("words")).alias("words"))
    kind = docs.schema["doc"].dataType.simpleString()
    packs = store(
        _map(
            rows,
            _packs,
            f"pack long, docs array<{kind}>, sizes array<int>, names array<binary>, gaps array<int>, tf array<int>, "
            "terms array<string>, held array<int>",
        ),
        compression="zstd",
    )
    held = packs.select("pack", F.posexplode(F.arrays_zip("terms", "held")).alias("pos", "_held"))
    held = held.select("pack", "pos", F.col("_held.terms").alias("term"), F.col("_held.held").alias("n"))
    frequent = held.groupBy("term").agg(F.sum("n").alias("df")).where("df > 1")
    numbered = global_index(frequent, [F.col("df"), F.col("term")], "id")
    back = held.select("pack", "pos", "term").join(numbered, "term")
    back = back.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "df"))).alias("numbers"))
    return packs.drop("held").join(back, "pack", "left").withColumn("n_docs", F.lit(docs.count()).cast("long"))


class _Pack:
    """The documents of a pack with an entry each for their distinct terms, in the order of the terms' names."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def whole(name: str) -> np.ndarray:
            return batch.column(name).slice(row, 1).flatten().to_numpy()

        self.docs = batch.column("docs").slice(row, 1).flatten()
        self.sizes = whole("sizes").astype(np.int64)
        self.tf = whole("tf").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        gaps = whole("gaps").astype(np.int64)
        run = np.cumsum(gaps)
        filled = self.sizes > 0
        before = run[self.starts[filled]] - gaps[self.starts[filled]]
        self.code = run - np.repeat(before, self.sizes[filled])
        numbers = batch.column("numbers").slice(row, 1).flatten()
        n = int(self.code.max(initial=-1)) + 1
        known = numbers.field("pos").to_numpy()
        ids, df = np.full(n, -1, np.int64), np.ones(n)
        ids[known], df[known] = numbers.field("id").to_numpy(), numbers.field("df").to_numpy()
        self.ids = ids[self.code]
        n_docs = batch.column("n_docs")[row].as_py()
        raw = self.tf * (np.log((1 + n_docs) / (1 + df)) + 1)[self.code]
        square = np.zeros(len(self.sizes))
        if len(raw):
            square[filled] = np.add.reduceat(raw * raw, self.starts[filled])
        self.weights = raw / np.repeat(np.sqrt(square), self.sizes)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Pack]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch, row, _Pack(batch, row)


def unpacked(packs: DataFrame) -> DataFrame:
    """``doc, term, tf, weight`` of packs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, row, pack in _each(batches):
            terms = batch.column("terms").slice(row, 1).flatten()
            owner = np.repeat(np.arange(len(pack.sizes)), pack.sizes)
            for at in range(0, len(owner), 100_000):
                part = slice(at, at + 100_000)
                yield {
                    "doc": pack.docs.take(pa.array(owner[part])),
                    "term": terms.take(pa.array(pack.code[part])),
                    "tf": pack.tf[part],
                    "weight": pack.weights[part],
                }

    kind = packs.schema["docs"].dataType.elementType.simpleString()
    return _map(packs, rows, f"doc {kind}, term string, tf long, weight double")


def named(packs: DataFrame) -> DataFrame:
    """``pack, pos, doc, name`` of documents with terms; equal documents have one name."""
    each = packs.select("pack", F.posexplode(F.arrays_zip("docs", "names", "sizes")).alias("pos", "_doc"))
    return each.where("_doc.sizes > 0").select("pack", "pos", F.col("_doc.docs").alias("doc"), F.col("_doc.names").alias("name"))


# --- blocks ---------------------------------------------------------------------
Part = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]


def _written(folder: str, parts: Iterator[Part]) -> Iterator[dict]:
    """Writes (docs, sizes, ids, weights), ids ascending in each document, to files of up to a block."""

    def written(held: list[Part]) -> dict:
        docs, sizes = _joined([x[0] for x in held]), np.concatenate([x[1] for x in held])
        ids, weights = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        docs, sizes, ids, weights = _long_first(docs, sizes, ids, weights)
        steps = np.diff(ids, prepend=0).astype(np.int32 if ids.max() < 1 << 31 else np.int64)
        columns = {"docs": docs, "sizes": sizes, "steps": steps, "weights": weights}
        batch = pa.RecordBatch.from_pydict({k: _one(v) for k, v in columns.items()})
        path = f"{folder}/{uuid.uuid4().hex}.arrow"
        system, plain = _file_system(path)
        system.create_dir(plain.rpartition("/")[0], recursive=True)
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        with (
            system.open_output_stream(plain, compression=None) as out,
            pa.ipc.new_stream(out, batch.schema, options=options) as sink,
        ):
            sink.write_batch(batch)
        return {"path": [path], "n_docs": [len(docs)], "entries": [len(ids)], "last": [ids.max()]}

    held, n_docs, entries = [], 0, 0
    for part in parts:
        if held and (entries + len(part[2]) > BLOCK_ENTRIES or n_docs + len(part[0]) > BLOCK_DOCS):
            yield written(held)
            held, n_docs, entries = [], 0, 0
        held.append(part)
        n_docs, entries = n_docs + len(part[0]), entries + len(part[2])
    if held:
        yield written(held)


def _long_first(docs: pa.Array, sizes: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> Part:
    if len(sizes) < 2 or np.diff(sizes).max() <= 0:
        return docs, sizes, ids, weights
    order = np.argsort(-sizes, kind="stable")
    moved = _ranges((np.cumsum(sizes) - sizes)[order], sizes[order])
    return docs.take(pa.array(order)), sizes[order], ids[moved], weights[moved]


FILES = "path string, n_docs long, entries long, last long"


def _kept(docs: pa.Array, sizes: np.ndarray, ids: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> Part | None:
    """Entries of known terms, by their numbers, of the documents wanted; those without any go."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    chosen = np.flatnonzero(wanted[owner] & (ids >= 0))
    bits = int(ids.max(initial=0)).bit_length(), len(chosen).bit_length()
    if len(sizes).bit_length() + sum(bits) < 64:  # one sort of document, term and place together
        key = (((owner[chosen] << bits[0]) | ids[chosen]) << bits[1]) | np.arange(len(chosen))
        key.sort()
        chosen = chosen[key & ((1 << bits[1]) - 1)]
    else:
        chosen = chosen[np.lexsort((ids[chosen], owner[chosen]))]
    left = np.bincount(owner[chosen], minlength=len(sizes))
    rows = np.flatnonzero(left)
    return (docs.take(pa.array(rows)), left[rows], ids[chosen], weights[chosen]) if len(rows) else None


def files_of_packs(packs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Files of vectors, without the documents at ``pack, pos``."""
    folder = work_dir(packs.sparkSession, "blocks")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def parts() -> Iterator[Part]:
            for batch, row, pack in _each(batches):
                wanted = np.ones(len(pack.sizes), bool)
                wanted[batch.column("dropped").slice(row, 1).flatten().to_numpy()] = False
                part = _kept(pack.docs, pack.sizes, pack.ids, pack.weights, wanted)
                if part:
                    yield part

        yield from _written(folder, parts())

    without = dropped.groupBy("pack").agg(F.collect_list("pos").alias("dropped"))
    needed = packs.select("pack", "docs", "sizes", "gaps", "tf", "numbers", "n_docs").join(without, "pack", "left")
    return _map(needed, rows, FILES)


def files_of_rows(vectors: DataFrame) -> DataFrame:
    """Files of vectors ``doc, term, weight``."""
    folder = work_dir(vectors.sparkSession, "blocks")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def parts() -> Iterator[Part]:
            for batch in batches:
                ids, weights = batch.column("ids"), batch.column("weights")
                sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
                flat = ids.flatten().to_numpy(), weights.flatten().to_numpy()
                part = _kept(batch.column("doc"), sizes, *flat, np.ones(len(sizes), bool))
                if part:
                    yield part

        yield from _written(folder, parts())

    frequent = vectors.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    numbered = global_index(frequent, [F.col("df"), F.col("term")], "id")
    entries = vectors.where(F.col("doc").isNotNull()).join(numbered, "term").groupBy("doc")
    entries = entries.agg(F.collect_list(F.struct("id", "weight")).alias("_entries"))
    needed = entries.select("doc", F.col("_entries.id").alias("ids"), F.col("_entries.weight").alias("weights"))
    return _map(needed, rows, FILES)


class _Block:
    """Vectors of some files, long ones first, and for each term the documents that list it.

    A document's terms are in order from rare to frequent, and it lists a term
    while what is left of it, the term included, is as long as the threshold.
    ``end`` is the first term it does not list, ``rest`` the length from there on.
    ``cuts`` has the part of all terms that a term is in, parts following each
    other; ``lengths`` are those from the start of each part on, or a little more,
    and ``cut`` is the part of the end.
    """

    def __init__(self, paths: list[str], cuts: np.ndarray, threshold: float):
        tables = []
        for path in paths:
            system, plain = _file_system(path)
            with system.open_input_file(plain) as source, pa.ipc.open_stream(source) as stream:
                tables.append(stream.read_next_batch())

        def whole(name: str, change: Callable = lambda x: x) -> np.ndarray:
            return np.concatenate([change(t.column(name).flatten().to_numpy()) for t in tables])

        def ids(steps: np.ndarray) -> np.ndarray:
            return np.cumsum(steps, dtype=np.int64).astype(np.int32 if len(cuts) <= 1 << 31 else np.int64)

        docs = _joined([t.column("docs").flatten() for t in tables])
        held = docs, whole("sizes"), whole("steps", ids), whole("weights")
        self.docs, self.sizes, self.ids, self.weights = _long_first(*held)
        del tables, held
        give_back_memory()
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(self.sizes)
        self.heavy = int(np.ceil(n * HEAVY))
        n_cuts = int(cuts[-1]) + 1
        owner = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        square = self.weights**2
        cell = owner * np.int32(n_cuts) + cuts[self.ids]
        lengths = np.bincount(cell, square, n * n_cuts).reshape(n, n_cuts)
        self.lengths = (np.sqrt(np.cumsum(lengths[:, ::-1], axis=1)[:, ::-1]) + SLACK).astype(np.float32)
        del cell, lengths, square
        left = self.weights**2
        left -= np.cumsum(left)
        last = self.starts + self.sizes - 1
        left -= np.repeat(left[last] - self.weights[last] ** 2, self.sizes)
        np.sqrt(np.maximum(left, 0, out=left), out=left)
        listed = np.flatnonzero(left >= threshold - SLACK)
        # by document
        self.doc_of, self.weight_of = owner[listed], self.weights[listed].astype(np.float32)
        self.n_listed = np.bincount(self.doc_of, minlength=n)
        self.first = np.cumsum(self.n_listed) - self.n_listed
        after = np.minimum(self.starts + self.n_listed, len(left) - 1)
        more = self.n_listed < self.sizes
        self.end = np.where(more, self.ids[after], np.iinfo(np.int64).max)
        self.rest = np.where(more, left[after], 0.0)
        self.cut = np.where(more, cuts[self.ids[after]], n_cuts - 1)
        del owner, left
        # by term, documents in order; one sort of term and place together
        shift = len(listed).bit_length()
        order = self.ids[listed].astype(np.int64) << shift
        order |= np.arange(len(listed))
        order.sort()
        term = (order >> shift).astype(np.int32)
        order &= (1 << shift) - 1
        del listed
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.list_docs, self.list_weights = self.doc_of[order], self.weight_of[order]
        self.list_first = np.flatnonzero(np.diff(term, prepend=-1))
        self.terms = term[self.list_first]
        self.list_end = np.append(self.list_first[1:], len(term))[: len(self.terms)]
        self.list_of = np.empty(len(order), np.int32)
        self.list_of[order] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.list_end - self.list_first)
        run = np.append(0, np.cumsum(self.list_docs < self.heavy, dtype=np.int32))
        self.list_heavy = run[self.list_end] - run[self.list_first]


def _cuts(n_terms: int) -> np.ndarray:
    """For each term the part it is in; the parts get smaller towards the most frequent terms."""
    starts = n_terms - np.geomspace(max(n_terms, 1), 1, CUTS).astype(np.int64)
    part = np.searchsorted(np.unique(np.append(0, starts)), np.arange(max(n_terms, 1)), side="right") - 1
    return part.astype(np.int32)


def _at(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in ``terms``, which are in order, and whether they are there."""
    place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return place, terms[place] == wanted


def _matrix(block: _Block, columns: np.ndarray) -> np.ndarray:
    """Weights of the terms ``columns`` that the heavy documents list."""
    held = np.zeros((block.heavy, len(columns)), np.float32)
    lines = slice(0, int(block.n_listed[: block.heavy].sum()))
    place, there = (x[block.list_of[lines]] for x in _at(columns, block.terms))
    held[block.doc_of[lines][there], place[there]] = block.weight_of[lines][there]
    return held


def _candidates(one: _Block, two: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a document of ``one`` and one of ``two``, or of a later one where both are the same, that may be similar.

    Products of the terms that both list are summed. All terms they share before
    the nearer of their ends are among these; from there on, the product is at
    most that of the two lengths that are left. Most products are of terms that
    many of the longest documents list; they are summed as a product of matrices.
    """
    if not len(one.terms) or not len(two.terms):
        return
    width, same = len(two.sizes), one is two
    place, shared = _at(two.terms, one.terms)
    term, there = place[one.list_of], shared[one.list_of]
    start = one.place + 1 if same else two.list_first[term]
    # matrices
    density = np.where(shared, one.list_heavy / one.heavy * (two.list_heavy[place] / two.heavy), 0)
    columns = np.flatnonzero(density >= MATRIX)
    columns = np.sort(columns[np.argsort(-density[columns], kind="stable")[:COLUMNS]])
    if len(columns):
        left, right = (_matrix(x, one.terms[columns]) for x in (one, two))
        heavy_lines = int(one.n_listed[: one.heavy].sum())
        dealt = np.zeros(len(two.terms), bool)
        dealt[place[columns]] = True
        beyond = (two.list_first + two.list_heavy)[term[:heavy_lines]]
        start[:heavy_lines] = np.where(
            dealt[term[:heavy_lines]], np.maximum(beyond, start[:heavy_lines]), start[:heavy_lines]
        )
    counts = np.where(there, two.list_end[term] - start, 0)
    run = np.append(0, np.cumsum(np.bincount(one.doc_of, counts, len(one.sizes)))).astype(np.int64)
    at, n = 0, len(one.sizes)
    while at < n:
        # a table of sums for few documents with many products, a sort for many with few
        till = min(at + max(CELLS // width, 1), n)
        heavy = len(columns) > 0 and at < one.heavy
        dense = heavy or run[till] - run[at] >= DENSE * (till - at) * width
        if not dense:
            till = max(int(np.searchsorted(run, run[at] + PRODUCTS, side="right")) - 1, at + 1)
        elif heavy:
            till = min(till, one.heavy)
        base, rows, at = at, till - at, till
        lines = np.arange(one.first[base], one.first[till - 1] + one.n_listed[till - 1])
        lines = lines[counts[lines] > 0]
        ends = np.cumsum(counts[lines])
        sums, done = None, 0
        while done < len(lines):
            most = np.searchsorted(ends, (ends[done - 1] if done else 0) + PRODUCTS, side="right")
            part = lines[done : max(int(most), done + 1)]
            done += len(part)
            which = _ranges(start[part], counts[part])
            cell = np.repeat((one.doc_of[part] - np.int64(base)) * width, counts[part])
            cell += two.list_docs[which]
            product = two.list_weights[which]
            product *= np.repeat(one.weight_of[part], counts[part])
            if not dense:
                sums = _summed(cell, product, sums)
            elif sums is None:
                sums = np.bincount(cell, product, rows * width)
            else:
                sums += np.bincount(cell, product, rows * width)
        if heavy:
            sums = np.zeros(rows * width) if sums is None else sums
            sums.reshape(rows, width)[:, : two.heavy] += left[base:till] @ right.T
        if sums is None:
            continue
        if dense:
            # by column first, with the largest bound of any row
            some = slice(base, till)
            most = np.maximum(
                one.rest[some].max() * two.lengths[:, one.cut[some].min()],
                two.rest * one.lengths[some].max(axis=0)[two.cut],
            )
            least = np.maximum(threshold - SLACK - most, SLACK / 2)
            cell = np.flatnonzero(sums.reshape(rows, width) >= least)
            sums = sums[cell]
        else:
            cell, sums = sums
        a = cell // width
        b = cell - a * width
        a += base
        if heavy and same:
            later = b > a
            a, b, sums = a[later], b[later], sums[later]
        bound = np.where(
            one.end[a] <= two.end[b], one.rest[a] * two.lengths[b, one.cut[a]], two.rest[b] * one.lengths[a, two.cut[b]]
        )
        kept = sums + bound >= threshold - SLACK
        if kept.any():
            yield a[kept], b[kept]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in larger lots, so that those of a document are mostly together."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n > TOLD:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _summed(cell: np.ndarray, product: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None):
    if before is not None:
        cell, product = np.concatenate([before[0], cell]), np.concatenate([before[1], product])
    shift = len(cell).bit_length()
    order = np.sort((cell << shift) | np.arange(len(cell)))
    cell, product = order >> shift, product[order & ((1 << shift) - 1)]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[first], np.add.reduceat(product.astype(np.float64), first)


def _products(one: _Block, two: _Block, a: np.ndarray, b: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Cosines of pairs, worked out over all terms; ``full`` has a 0 for each term, before and after."""
    found = np.empty(len(a))
    shorter = two.sizes[b] <= one.sizes[a]
    for long, short, x, y, which in (
        (one, two, a, b, np.flatnonzero(shorter)),
        (two, one, b, a, np.flatnonzero(~shorter)),
    ):
        which = which[np.argsort(x[which], kind="stable")]
        starts, ends = short.starts[y[which]].tolist(), (short.starts + short.sizes)[y[which]].tolist()
        values, last, own = [], -1, slice(0, 0)
        for d, start, end in zip(x[which].tolist(), starts, ends, strict=True):
            if d != last:
                full[long.ids[own]] = 0.0
                last, own = d, slice(long.starts[d], long.starts[d] + long.sizes[d])
                full[long.ids[own]] = long.weights[own]
            values.append(full.take(short.ids[start:end]) @ short.weights[start:end])
        full[long.ids[own]] = 0.0
        found[which] = values
    return found


def pairs_of_files(files: DataFrame, kind: str, threshold: float, exact: bool = True) -> DataFrame:
    """``a, b, similarity`` (a < b) of the vectors in ``files``: all pairs with a cosine of ``threshold`` or more.

    Files are put together to blocks, and each two blocks meet in one task, which
    holds a few blocks at a time. No pair and no vector is shuffled. Without ``exact`` all
    pairs are told that the sums over listed terms leave, with a similarity of NaN.
    """
    spark = files.sparkSession
    known = files.collect()
    most = max(min(BLOCK_ENTRIES, sum(x.entries for x in known) // LEAST_BLOCKS), 1)
    blocks, entries, n_docs = [], 0, 0
    for x in known:
        if not blocks or entries + x.entries > most or n_docs + x.n_docs > BLOCK_DOCS:
            blocks.append([])
            entries, n_docs = 0, 0
        blocks[-1].append(x.path)
        entries, n_docs = entries + x.entries, n_docs + x.n_docs
    n_terms = max((x.last for x in known), default=-1) + 1
    cuts = _cuts(n_terms)
    every = range(len(blocks))
    starts = [(i, j) for i in every[::HELD_BLOCKS] for j in every[i::TASK_BLOCKS]]

    def told(i: int, j: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        full = np.zeros(n_terms if exact else 0)
        held = {k: _Block(blocks[k], cuts, threshold) for k in every[i : i + HELD_BLOCKS]}
        for k in every[j : j + TASK_BLOCKS]:
            two = None  # goes before the next one comes
            two = held[k] if k in held else _Block(blocks[k], cuts, threshold)
            for one in [held[x] for x in held if x <= k]:
                for a, b in _gathered(_candidates(one, two, threshold)):
                    similarity = np.full(len(a), np.nan)
                    if exact:
                        similarity = _products(one, two, a, b, full)
                        kept = similarity >= threshold
                        a, b, similarity = a[kept], b[kept], similarity[kept]
                    if len(a):
                        yield one.docs.take(pa.array(a)), two.docs.take(pa.array(b)), similarity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                held, n = [], 0
                for found in told(*starts[number]):
                    held.append(found)
                    n += len(found[2])
                    if n > TOLD:
                        yield rows_of(held)
                        held, n = [], 0
                if held:
                    yield rows_of(held)

    def rows_of(held: list) -> dict:
        x, y, similarity = zip(*held, strict=True)
        return {"x": _joined(list(x)), "y": _joined(list(y)), "similarity": np.concatenate(similarity)}

    number = spark.range(0, len(starts), 1, max(len(starts), 1))
    met = _map(number, rows, f"x {kind}, y {kind}, similarity double")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
