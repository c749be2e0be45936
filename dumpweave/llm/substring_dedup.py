"""Exact substring deduplication with per-shard suffix arrays.

Which strings can meet is settled first. The key of a 200-byte string is the
smallest hash of its 64-byte substrings: equal strings have equal keys, wherever
they are. Consecutive starts with one key form a run; only runs whose key occurs
in two places can hold a repeat, and their bytes are dealt to shards by key.
Each shard sorts its suffixes by Larsson-Sadakane refinement (ranks of 8 bytes,
doubled up to 200; only groups that are not yet told apart are sorted again) and
takes common prefixes of neighbours by Kasai's scheme. Keys with too many runs
for one task are split over shards; their strings are matched across shards by a
digest of each, as a binary search would have to hold one shard's list whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import map_batches, map_partition
from dumpweave.plans.session import discard, store

LENGTH = 200
GRAM = 64
# runs of one key in one shard; a key with more is split
SHARD_RUNS = 20_000
# bytes of distinct runs that one suffix array covers, beside its last key
SHARD_BYTES = 4 << 20


# --- runs -----------------------------------------------------------------------------


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    # of windows twice as wide each time; two that overlap make the last
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - width + size], values[width - size :])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, first start, last start, key) of the runs of equal keys in each text.

    A start of -1 only tells that the key occurs twice within a run.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.view(K.U64)
    sums = K.running_hash(data)
    grams = (sums[gram:] - sums[:-gram]) * K.powers(len(sums))[1][: len(sums) - gram]
    grams = K.mix(grams)
    keys = _sliding_minimum(grams, length - gram + 1)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[:-1][text]
    if not len(start):
        return empty, empty, empty, empty.view(K.U64)
    window_keys = keys = keys[start]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])))
    last = np.append(new[1:], len(start)) - 1
    own = text[new]
    first, last, keys = start[new] - offsets[own], start[last] - offsets[own], keys[new]
    # A run may hold a repeat in itself if its key's substring occurs twice near
    # by. A place has a key's substring if some window takes its hash.
    width = length - gram + 1
    taken = np.zeros(len(grams) + width - 1, dtype=K.U64)
    taken[start + width - 1] = window_keys
    places = np.flatnonzero(grams == ~_sliding_minimum(~taken, width)[: len(grams)])
    again = (grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) < width)
    twice = np.flatnonzero(np.isin(keys, grams[places[1:][again]]))
    # such a run is told as a second place of its key, before the text
    nowhere = np.full(len(twice), -1)
    return (
        np.append(own, own[twice]),
        np.append(first, nowhere),
        np.append(last, nowhere),
        np.append(keys, keys[twice]),
    )


# --- one shard ------------------------------------------------------------------------


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number; zeros follow the end."""
    padded = np.append(data, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    n = len(data)
    for width in (1, 2, 4):
        padded[: len(padded) - width] = padded[: len(padded) - width] << np.uint64(8 * width) | padded[width:]
    return padded[:n]


def refined_ranks(words: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Rank of each place by its next ``length`` bytes, equal for equal bytes.

    Larsson and Sadakane: a place's rank is the first slot of its group in the
    sorted order; groups of two or more are sorted again by the rank of the
    place as many bytes ahead as are sorted already. ``room`` is the number of
    bytes left in a place's run; a place without room for the depth is left out.
    """
    n = len(words)
    order = np.argsort(words).astype(np.int32)
    slots = np.arange(n, dtype=np.int32)
    ordered = words[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if n else np.zeros(0, dtype=bool)
    rank = np.zeros(n + length, dtype=np.int32)
    rank[order] = slots[np.maximum.accumulate(np.where(new, slots, 0))]
    depth = min(8, length)
    while depth < length:
        step = min(depth, length - depth)
        # of the places not told apart yet, those with room
        alone = new & np.append(new[1:], True)
        keep = ~alone & (room[order] >= depth + step)
        order, slots = order[keep], slots[keep]
        key = rank[order].astype(np.int64) << 32 | rank[order + step].astype(np.int64)
        by = np.argsort(key)
        order, key = order[by], key[by]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[order] = slots[head]
        depth += step
    return rank[:n]


def suffix_order(rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts in the order of their strings; equal ones in the order of place."""
    return starts[np.argsort(rank[starts], kind="stable")]


def common_prefixes(words: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """For each place in ``order`` the bytes it shares with the one before, up to ``length``.

    Kasai: going through a text, the next place shares at least one byte less
    than this one did. All runs (``first`` to ``last``) are gone through side by
    side. Returned by place.
    """
    n = len(words)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    ending = np.zeros(n + 1, dtype=bool)
    ending[last] = True
    shared = np.zeros(n, dtype=np.int16)
    at, stop, have = first.copy(), last, np.zeros(len(first), dtype=np.int64)
    # where the count stopped at ``length``, the order beyond it is open: the
    # next count may build on it only if the same two places go on
    follows = np.full(len(first), -1, dtype=np.int64)
    while len(at):
        other = previous[at]
        have[(other < 0) | (have >= length - 1) & (other != follows)] = 0
        open_ = np.flatnonzero((other >= 0) & (have < length))
        while len(open_):
            a, b = at[open_] + have[open_], other[open_] + have[open_]
            differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            # equal leading bytes of the eight
            same = np.full(len(open_), 8)
            for i in range(7, -1, -1):
                same[(differ >> np.uint64(56 - 8 * i)) & np.uint64(255) != 0] = i
            have[open_] = np.minimum(have[open_] + same, length)
            open_ = open_[(same == 8) & (have[open_] < length)]
        shared[at] = have
        # the place after ``other`` is in the order only within its run
        have = np.where((other >= 0) & ~ending[other], np.maximum(have - 1, 0), 0)
        go = at < stop
        at, stop, have, follows = at[go] + 1, stop[go], have[go], other[go] + 1
    return shared


def repeated_starts(pieces: list[bytes], copies: np.ndarray, length: int):
    """For distinct runs: which starts hold a string that starts elsewhere too.

    ``copies`` tells how many places a whole run stands for; with two or more
    all its starts are repeated. Returns per run the flags, and per run the
    place of its first start in the concatenation with the ranks.
    """
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum(sizes)
    first = ends - sizes
    last = ends - length
    words = eight_bytes(data)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    rank = refined_ranks(words, room, length)
    starts = np.flatnonzero(room >= length)
    order = suffix_order(rank, starts)
    shared = common_prefixes(words, order, first, last, length)
    flags = np.zeros(len(data), dtype=bool)
    equal = shared[order] >= length
    flags[order[equal]] = True
    flags[order[:-1][equal[1:]]] = True
    for i in np.flatnonzero(copies > 1):
        flags[first[i] : last[i] + 1] = True
    return flags, first, last


# --- over the corpus --------------------------------------------------------------------


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Whole (key, part) groups, as many as make one suffix array."""
    columns = ("key", "part", "parts", "text_hash", "n_bytes", "lo", "hi", "bytes")
    rest: dict = {c: [] for c in columns}
    held = 0
    for batch in batches:
        values = {c: batch.column(c).to_pylist() for c in columns}
        for i in range(batch.num_rows):
            group = (values["key"][i], values["part"][i])
            if held > SHARD_BYTES and group != (rest["key"][-1], rest["part"][-1]):
                yield rest
                rest, held = {c: [] for c in columns}, 0
            for c in columns:
                rest[c].append(values[c][i])
            held += len(values["bytes"][i])
    if rest["key"]:
        yield rest


def _search_shard(group: dict, length: int) -> Iterator[dict]:
    """Runs of repeated starts, and of split keys the strings that other shards must know."""
    # a run may come twice if its text does; equal runs are sorted once
    owners: dict[tuple, set] = {}
    split = {}
    for key, parts, text, n, lo, hi, raw in zip(
        *(group[c] for c in ("key", "parts", "text_hash", "n_bytes", "lo", "hi", "bytes")), strict=True
    ):
        owners.setdefault((key, raw), set()).add((text, n, lo, hi))
        split[key] = parts > 1
    pieces = [raw for _, raw in owners]
    copies = np.array([len(x) for x in owners.values()])
    flags, first, last = repeated_starts(pieces, copies, length)
    out: dict[str, list] = {c: [] for c in ("text_hash", "n_bytes", "lo", "hi", "name_a", "name_b")}

    def add(text: int, n: int, lo: int, hi: int, name_a: int | None = None, name_b: int | None = None) -> None:
        for c, v in zip(out, (text, n, lo, hi, name_a, name_b), strict=True):
            out[c].append(v)

    for (key, raw), places, a, b in zip(owners, owners.values(), first.tolist(), last.tolist(), strict=True):
        own = flags[a : b + 1]
        edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for text, n, lo, _ in places:
                add(text, n, lo + s, lo + e - 1)
        if split[key]:
            for s in range(b - a + 1):
                digest = hashlib.blake2b(raw[s : s + length], digest_size=16).digest()
                name = np.frombuffer(digest, dtype="<i8").tolist()
                text, n, lo, _ = next(iter(places))
                # a repeated string is only announced; one met once here waits for others
                add(text, n, lo + s, lo + s, *name)
    if out["lo"]:
        yield out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(text_hash, n_bytes, lo, hi): runs of starts, in distinct texts, of strings that start elsewhere too."""
    columns = ("text_hash", "n_bytes", "lo", "hi", "key")
    schema = "text_hash long, n_bytes int, lo int, hi int, key long"

    def runs(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, data, offsets in K.chunks(batch):
            text, lo, hi, key = runs_of(data, offsets, length, gram)
            own = [part.column(c).to_numpy()[text] for c in ("text_hash", "n_bytes")]
            yield dict(zip(columns, (*own, lo, hi, key.view(np.int64)), strict=True))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        rows: dict[str, list] = {c: [] for c in ("key", "part", "parts", "text_hash", "n_bytes", "lo", "hi", "bytes")}
        for row in range(batch.num_rows):
            raw = memoryview(batch.column("text")[row].as_buffer())
            for run in batch.column("runs")[row].as_py():
                for c in ("key", "part", "parts", "lo", "hi"):
                    rows[c].append(run[c])
                rows["text_hash"].append(batch.column("text_hash")[row].as_py())
                rows["n_bytes"].append(batch.column("n_bytes")[row].as_py())
                rows["bytes"].append(bytes(raw[run["lo"] : run["hi"] + length]))
        yield rows

    long = docs.where(F.col("n_bytes") >= length)
    # read twice: once for the keys, once for the runs whose key is shared
    found = store(map_batches(long.select("text_hash", "n_bytes", "text"), runs, schema), compression="zstd")
    # places of a key, told apart by their hash; copies of a text count once
    place = F.xxhash64("text_hash", "n_bytes", "lo")
    shared = (
        found.groupBy("key")
        .agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count(F.lit(1)).alias("runs"))
        .where("least <> most")
        .select("key", F.ceil(F.col("runs") / SHARD_RUNS).cast("int").alias("parts"))
    )
    wanted = found.where("lo >= 0").join(shared, "key").withColumn("part", F.pmod(F.xxhash64("text_hash", "lo"), "parts").cast("int"))
    # runs of one text, at most one for each of its bytes
    by_text = wanted.groupBy("text_hash", "n_bytes").agg(
        F.collect_set(F.struct("key", "part", "parts", "lo", "hi")).alias("runs")
    )
    texts = long.select("text_hash", "n_bytes", F.col("text").cast("binary").alias("text"))
    pieces = map_batches(
        texts.join(by_text, ["text_hash", "n_bytes"]),
        cut,
        "key long, part int, parts int, text_hash long, n_bytes int, lo int, hi int, bytes binary",
    )
    dealt = pieces.repartition("key", "part").sortWithinPartitions("key", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in _shards(batches):
            yield from _search_shard(group, length)

    spans = store(
        map_partition(dealt, search, "text_hash long, n_bytes int, lo int, hi int, name_a long, name_b long")
    )
    discard(found)
    # across the shards of a split key: strings that two of them know
    names = spans.where("name_a is not null")
    both = (
        names.groupBy("name_a", "name_b")
        .agg(F.min(place).alias("least"), F.max(place).alias("most"))
        .where("least <> most")
        .select("name_a", "name_b")
    )
    across = names.join(both, ["name_a", "name_b"])
    return spans.where("name_a is null").select(*columns[:4]).union(across.select(*columns[:4]))


def _without(batch: pa.RecordBatch, length: int) -> Iterator[dict]:
    rows: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for row in range(batch.num_rows):
        raw = batch.column("text")[row].as_buffer().to_pybytes()
        spans = sorted((s["lo"], s["hi"] + length) for s in batch.column("spans")[row].as_py() or ())
        if batch.column("copied")[row].as_py():
            spans = [(0, len(raw))]
        merged: list[list[int]] = []
        for lo, hi in spans:
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        kept, at = [], 0
        for lo, hi in merged:
            kept.append(raw[at:lo])
            at = hi
        left = b"".join([*kept, raw[at:]])
        rows["doc_id"].append(batch.column("doc_id")[row].as_py())
        rows["n_bytes"].append(len(raw))
        rows["n_removed"].append(len(raw) - len(left))
        rows["n_spans"].append(len(merged))
        rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        rows["kept"].append(left)
    yield rows


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without the bytes of strings that start elsewhere too.

    A string is ``length`` bytes of UTF-8 within one text; it is repeated if it
    starts at another place of any row's text, its own included. Columns:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    the bytes left (``kept``, binary: a cut may fall inside a character).

    A null text is an empty one and loses nothing, as do texts shorter than
    ``length``. Rows with equal texts of at least ``length`` bytes lose all
    bytes, also where they share a doc_id or have none. Other columns are left
    out. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"text_hash": F.xxhash64("text"), "n_bytes": F.octet_length("text")})
    keys = ["text_hash", "n_bytes"]
    copied = (
        docs.select(*keys)
        .where(F.col("n_bytes") >= length)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select(*keys, F.lit(True).alias("copied"))
    )
    spans = (
        repeated_spans(docs, length, gram)
        .groupBy(*keys)
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    )
    known = spans.join(copied, keys, "full_outer")
    rows = docs.join(known, keys, "left").select(
        "doc_id", F.col("text").cast("binary").alias("text"), "spans", "copied"
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return map_batches(rows, lambda b: _without(b, length), schema)
