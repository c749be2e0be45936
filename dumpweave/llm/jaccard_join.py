"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two sets with a Jaccard similarity of at least t share at least T tokens. A
set's tokens are put in one global order, rare ones first. The inverted lists
of its rarest ``n - ceil(t n) + 1`` tokens are the short ones: a partner occurs
in at least one of them, so they are merged. The lists of its other, frequent
tokens are the long ones: they are never built or merged; a candidate is probed
for each of those tokens by binary search in its own sorted set.

Equal sets are folded into one node first. Lists are merged several times. First
each node of a list meets the first and the previous one only, and verified links
are folded into components; that is repeated in other orders, for the lists that
still cross components, while links are found. Then all pairs of a list meet whose
nodes still lie in different components, after exact bounds from length,
position and a parity bitmap. A pair counts in the first list that both sets are
in: later ones drop it by the bound of position, and where one of the lists just
before was common to both. A group of many near copies thus costs
about its size, and no link between components is lost. A list that is too long
for one task is split into blocks that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import aside, components, map_batches, map_partition
from dumpweave.plans.session import discard, store

# Counters of the token order. Tokens that share a counter are taken for as
# frequent as all of them together; any order gives the same result.
COUNTERS = 1 << 20
COUNTER_BLOCK = 1 << 13
BITMAP_WORDS = 16
# nodes of a list that one task compares with each other
BLOCK_NODES = 20_000
# times that each node of a list meets two others, at most
STAR_ROUNDS = 3
# lists before one of a node that tell whether a pair has met there
BEFORE = 8


@dataclass(frozen=True)
class Similar:
    """Words per shingle, and the least similarity as a fraction."""

    k: int
    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (n * self.num + self.den - 1) // self.den + 1

    def overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        whole = self.num + self.den
        return ((n + m) * self.num + whole - 1) // whole

    def lengths_agree(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (np.minimum(n, m) * self.den >= np.maximum(n, m) * self.num) & (n > 0) & (m > 0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (owner, hash), sorted by both."""
    lower = K.LOWER[data]
    starts, ends, first = K.word_spans(lower, offsets, K.NOT_SPACE)
    words = K.span_hash(K.running_hash(lower), starts, ends)
    owner = K.owners(first)
    size = np.diff(first)
    # a position starts a shingle if k words are left in its text
    whole = np.flatnonzero(first[1:][owner] - np.arange(len(words)) >= k)
    hashes = K.windows(words, k)[whole]
    owner = owner[whole]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        rest = [K.windows(words[first[i] : first[i + 1]], int(size[i])) for i in short]
        hashes = np.concatenate([hashes, *rest])
        owner = np.concatenate([owner, short])
    order = K.sort_by_owner(hashes, owner)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` of each text; texts without any give 0."""
    sums = np.zeros(len(values) + 1, dtype=K.U64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def set_names(owner: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each set, and a name that equal sets share."""
    first = np.searchsorted(owner, np.arange(rows + 1))
    size = np.diff(first)
    return size, K.mix(_per_text(K.mix(hashes ^ K.U64(K.BASE)), first) + size.astype(K.U64))


def _parity_bits(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """For each set a bitmap in which each token flips one bit.

    Two bitmaps differ in at most as many bits as there are tokens in one set only.
    """
    width = BITMAP_WORDS * 64
    bit = (K.mix(hashes) >> K.U64(32)).astype(np.int64) % width
    odd = np.bincount(owner * width + bit, minlength=rows * width) % 2
    return np.packbits(odd.astype(np.uint8).reshape(rows, width), axis=1).view(np.int64)


SETS = "doc_id long, n int, node long, bits array<long>, block int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch], how: Similar) -> Iterator[dict]:
    """A row for each text, and at a task's end rows with its counters, by block.

    A counter counts the texts with a token of that counter.
    """
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for part, data, offsets in K.chunks(batch, rows=1_000):
            rows = part.num_rows
            owner, hashes = shingle_sets(data, offsets, how.k)
            n, node = set_names(owner, hashes, rows)
            bits = _parity_bits(owner, hashes, rows)
            total += np.bincount((hashes >> K.U64(44)).astype(np.int64), minlength=COUNTERS)
            yield {
                "doc_id": part.column("doc_id"),
                "n": n,
                "node": node.view(np.int64),
                "bits": pa.ListArray.from_arrays(
                    pa.array(np.arange(0, bits.size + 1, BITMAP_WORDS), pa.int32()), pa.array(bits.ravel())
                ),
                "block": pa.nulls(rows),
                "counts": pa.nulls(rows),
            }
    if total.any():
        blocks = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, COUNTER_BLOCK)
        none = pa.nulls(len(blocks))
        yield {
            "doc_id": none, "n": none, "node": none, "bits": none,
            "block": np.arange(len(blocks)), "counts": [b.tobytes() for b in blocks],
        }


def token_counters(blocks: DataFrame) -> np.ndarray:
    """The sums of all tasks' counters: ``COUNTERS`` numbers, whatever the input."""

    def add(frame):
        import pandas as pd

        total = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in frame["counts"])
        capped = np.minimum(total, 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "counts": [capped.tobytes()]})

    total = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), dtype=np.int32)
    for row in blocks.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        total[row["block"]] = np.frombuffer(row["counts"], dtype=np.int32)
    return total.ravel()


def _short_lists(docs: DataFrame, counts: np.ndarray, how: Similar) -> DataFrame:
    """Entries (token, n, node, rank) of the lists to merge, in lists of two nodes or more.

    ``rank`` is the token's place in its set, rare tokens first.
    """
    counters = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 65_535).astype(np.uint16))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        frequency = counters.value
        for batch in batches:
            for part, data, offsets in K.chunks(batch):
                owner, hashes = shingle_sets(data, offsets, how.k)
                n, node = set_names(owner, hashes, part.num_rows)
                # copies within a task are listed once
                fresh = np.zeros(len(n), dtype=bool)
                for i, name in enumerate(node.tolist()):
                    if n[i] and name not in seen:
                        seen.add(name)
                        fresh[i] = True
                keep = fresh[owner]
                owner, hashes = owner[keep], hashes[keep]
                order = np.argsort(frequency[(hashes >> K.U64(44)).astype(np.int64)], kind="stable")
                order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
                first = np.searchsorted(owner, np.arange(len(n) + 1))
                rank = np.arange(len(owner)) - first[owner]
                short = rank < how.prefix(n)[owner]
                owner, rank, hashes = owner[short], rank[short], hashes[order][short]
                yield {
                    "token": hashes.view(np.int64),
                    "n": n[owner],
                    "node": node[owner].view(np.int64),
                    "rank": rank,
                }

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Drop repeats and lists of one node; a list may cross batches."""
        last: dict | None = None
        joined = False
        for batch in batches:
            now = {c: batch.column(c).to_numpy() for c in ("token", "n", "node", "rank")}
            if last is not None:
                now = {c: np.concatenate([last[c], now[c]]) for c in now}
            same_token = now["token"][1:] == now["token"][:-1]
            keep = np.append(True, ~(same_token & (now["node"][1:] == now["node"][:-1])))
            now = {c: v[keep] for c, v in now.items()}
            same = now["token"][1:] == now["token"][:-1]
            listed = np.zeros(len(now["token"]), dtype=bool)
            listed[1:] |= same
            listed[:-1] |= same
            listed[0] |= joined
            # the last entry waits for the next batch, which may go on with its list
            last = {c: v[-1:] for c, v in now.items()}
            joined = bool(listed[-1])
            listed[-1] = False
            yield {c: v[listed] for c, v in now.items()}
        if last is not None and joined:
            yield last

    schema = "token long, n int, node long, rank int"
    postings = map_partition(docs.select("text"), entries, schema)
    dealt = postings.repartition("token").sortWithinPartitions("token", "n", "node")
    return map_partition(dealt, shared, schema)


def _star_pairs(lists: DataFrame, how: Similar, salt: int) -> DataFrame:
    """Of each list the pairs (first, each) and (previous, each) from different components.

    Without ``salt`` smaller sets come first, with it the order is another one in each list.
    Pairs that this list cannot be the first to show are left out.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("token", "n", "node", "label", "rank")
        head = tail = None
        seen = np.zeros(0, dtype=[("a", "i8"), ("b", "i8")])
        for batch in batches:
            token, n, node, label, rank = (batch.column(c).to_numpy() for c in names)
            start = np.append(True, token[1:] != token[:-1])
            if tail is not None and token[0] == tail[0]:
                start[0] = False
            leader = np.maximum.accumulate(np.where(start, np.arange(len(token)), -1))

            def at(values: np.ndarray, index: np.ndarray, carried) -> np.ndarray:
                out = values[np.maximum(index, 0)]
                return out if carried is None else np.where(index < 0, carried, out)

            found = []
            for index, carried in ((leader, head), (np.arange(len(token)) - 1, tail)):
                m, other, its, place = (
                    at(v, index, None if carried is None else carried[i])
                    for v, i in ((n, 1), (node, 2), (label, 3), (rank, 4))
                )
                ok = ~start & (its != label) & how.lengths_agree(n, m)
                ok &= np.minimum(n - rank, m - place) >= how.overlap(n.astype(np.int64), m)
                found.append(
                    np.rec.fromarrays(
                        [np.minimum(node, other)[ok], np.maximum(node, other)[ok]], dtype=seen.dtype
                    )
                )
            if leader[-1] >= 0:
                head = tuple(v[leader[-1]] for v in (token, n, node, label, rank))
            tail = (token[-1], n[-1], node[-1], label[-1], rank[-1])
            fresh = np.unique(np.concatenate(found))
            fresh = fresh[~np.isin(fresh, seen)] if len(seen) else fresh
            seen = fresh
            yield {"a": fresh["a"], "b": fresh["b"]}

    order = F.xxhash64(F.lit(salt), "token", "node") if salt else F.col("n")
    dealt = lists.repartition("token").sortWithinPartitions("token", order, "node")
    entries = dealt.select("token", "n", "node", "label", "rank")
    return map_partition(entries, pairs, "a long, b long").distinct()


def _mixed(lists: DataFrame) -> DataFrame:
    """(token, size) of the lists with nodes from different components."""
    ends = lists.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    return ends.where("lo <> hi").select("token", "size")


def _all_pairs(lists: DataFrame, members: DataFrame, how: Similar) -> DataFrame:
    """Of each list all pairs from different components that pass the exact bounds.

    Lists within one component are left out before they are dealt.
    """
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    mixed = _mixed(lists).select("token", blocks.alias("blocks"))
    # the lists of a node are as many as its set has rare tokens
    in_turn = Window.partitionBy("node").orderBy("rank")
    before = [F.coalesce(F.lag("token", i).over(in_turn), F.lit(0)) for i in range(1, BEFORE + 1)]
    dealt = (
        lists.join(mixed, "token")
        .withColumn("before", F.array(*before))
        .join(members.select("node", "bits"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .repartition("token", "lo", "hi")
        .sortWithinPartitions("token", "lo", "hi", "n", "node")
        .select("token", "lo", "hi", "block", "n", "node", "rank", "label", "bits", "before")
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for lists in _whole_lists(batches):
            yield from _bounded_pairs(lists, how)

    return map_partition(dealt, pairs, "a long, b long").distinct()


LIST_KEYS = ("token", "lo", "hi")
# columns of arrays, and their length
WIDTHS = {"bits": BITMAP_WORDS, "before": BEFORE}


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Batches of a sorted stream cut between lists; one list is ``2 * BLOCK_NODES`` entries at most."""
    rest: dict | None = None
    for batch in batches:
        now = {
            c: batch.column(c).to_numpy()
            if c not in WIDTHS
            else batch.column(c).flatten().to_numpy().reshape(-1, WIDTHS[c])
            for c in batch.schema.names
        }
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in now}
        start = np.flatnonzero(_list_starts(now))[-1]
        if start:
            yield {c: v[:start] for c, v in now.items()}
        rest = {c: v[start:] for c, v in now.items()}
    if rest is not None:
        yield rest


def _list_starts(lists: dict) -> np.ndarray:
    start = np.zeros(len(lists["token"]), dtype=bool)
    start[:1] = True
    for c in LIST_KEYS:
        start[1:] |= lists[c][1:] != lists[c][:-1]
    return start


def _bounded_pairs(lists: dict, how: Similar) -> Iterator[dict]:
    """Pairs within each list, for all lists at once: entries and those d places on, for each d.

    Only the first token that two sets share has to give the pair.
    """
    n, rank, node, label = (lists[c].astype(np.int64) for c in ("n", "rank", "node", "label"))
    bits = np.ascontiguousarray(lists["bits"]).view(np.uint64)
    block, across, before = lists["block"], lists["lo"] != lists["hi"], lists["before"]
    number = np.cumsum(_list_starts(lists))
    i, d = np.arange(len(n)), 0
    while len(i):
        d += 1
        i = i[i + d < len(n)]
        # lists are sorted by n: once a partner's set is too long, later ones are too
        i = i[(number[i + d] == number[i]) & (n[i] * how.den >= n[i + d] * how.num)]
        j = i + d
        keep = (label[i] != label[j]) & (~across[i] | (block[i] != block[j]))
        a, b = i[keep], j[keep]
        need = how.overlap(n[a], n[b])
        # if this is the first shared token: it, and those that can follow
        most = np.minimum(n[a] - rank[a], n[b] - rank[b])
        a, b, need = (x[most >= need] for x in (a, b, need))
        for at in range(0, len(a), 100_000):
            x, y, least = (v[at : at + 100_000] for v in (a, b, need))
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            near = differ <= n[x] + n[y] - 2 * least
            x, y = x[near], y[near]
            earlier = before[x][:, :, None] == before[y][:, None, :]
            fresh = ~(earlier & (before[x] != 0)[:, :, None]).any(axis=(1, 2))
            x, y = x[fresh], y[fresh]
            if len(x):
                yield {"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])}


def _texts(nodes: DataFrame, members: DataFrame, docs: DataFrame, how: Similar) -> DataFrame:
    """(node, text) of the given nodes: the text of the document that stands for each.

    A bitmap of fixed size marks the wanted ids, so that few other texts are
    shuffled. Should an id be repeated, the text with the node's set counts.
    """
    wanted = store(members.select(F.col("rep").alias("doc_id"), "node").join(nodes, "node"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("int")
    marks = np.zeros(MARKS, dtype=bool)
    # at most ``MARKS`` numbers
    marks[wanted.select(place.alias("mark")).distinct().toPandas()["mark"].to_numpy(dtype=np.int64)] = True
    marked = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def choose(batch: pa.RecordBatch) -> Iterator[dict]:
        known = np.unpackbits(marked.value).view(bool)
        own = batch.filter(pa.array(known[batch.column("mark").to_numpy()]))
        yield {c: own.column(c) for c in ("doc_id", "text")}

    rows = docs.where("doc_id is not null").withColumn("mark", place)
    chosen = map_batches(rows, choose, "doc_id long, text string")
    # the join is no broadcast: with both Python steps in one task an executor would keep twice the workers
    met = chosen.join(wanted.hint("merge"), "doc_id").select("node", "text")
    own = map_batches(met, lambda b: _of_node(b, how), "node long, text string")
    return store(own.dropDuplicates(["node"]))


# bits of the bitmap of wanted documents
MARKS = 1 << 22


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, how: Similar) -> DataFrame:
    """Pairs whose sets reach the overlap: tokens of one probed in the sorted set of the other."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(nodes, members, docs, how)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def probe(batch: pa.RecordBatch) -> Iterator[dict]:
        for half, data, offsets in K.chunks(batch, "text_a"):
            data_b, offsets_b = K.utf8(half.column("text_b"))
            owner, hashes = shingle_sets(data, offsets, how.k)
            owner_b, hashes_b = shingle_sets(data_b, offsets_b, how.k)
            rows = half.num_rows
            n, m = np.bincount(owner, minlength=rows), np.bincount(owner_b, minlength=rows)
            # one sorted array of (pair, token) to search in
            sought = K.mix(hashes ^ K.mix(owner.astype(K.U64)))
            sorted_b = np.sort(K.mix(hashes_b ^ K.mix(owner_b.astype(K.U64))))
            if len(sorted_b):
                place = np.minimum(np.searchsorted(sorted_b, sought), len(sorted_b) - 1)
                hit = sorted_b[place] == sought
            else:
                hit = np.zeros(len(sought), dtype=bool)
            both = np.bincount(owner[hit], minlength=rows)
            linked = np.flatnonzero((both > 0) & (both >= how.overlap(n, m)))
            for c in ("a", "b"):
                assert half.column(c).null_count == 0
            yield {c: half.column(c).to_numpy()[linked] for c in ("a", "b")}

    found = store(map_batches(pairs.join(left, "a").join(right, "b"), probe, "a long, b long"))
    discard(texts)
    return found


def _by_bitmap(pairs: DataFrame, members: DataFrame, how: Similar, salt: int = 0) -> DataFrame:
    """Pairs that the parity bitmaps leave possible; of each node two partners at most, by ``salt``."""
    a = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    total = F.col("n_a") + F.col("n_b")
    need = F.ceil(total * how.num / (how.num + how.den))
    differ = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    possible = pairs.join(a, "a").join(b, "b").where(differ <= total - 2 * need + 1)
    place = F.xxhash64(F.lit(salt), "a")
    both = possible.select("a", "b").union(possible.select("b", "a"))
    ends = both.groupBy("b").agg(F.min_by("a", place).alias("least"), F.max_by("a", place).alias("most"))
    chosen = ends.select(F.explode(F.array("least", "most")).alias("a"), "b")
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star_links(
    lists: DataFrame, links: DataFrame, members: DataFrame, docs: DataFrame, how: Similar
) -> tuple[DataFrame, DataFrame]:
    """Components (node, label) of the given links and those found in rounds of ``_star_pairs``; the labelled lists."""
    known = lists.withColumn("label", F.col("node"))
    for turn in range(STAR_ROUNDS):
        salts = (turn + 1,) if turn else (0, 1)
        stars = _star_pairs(known, how, salts[0])
        for salt in salts[1:]:
            stars = stars.union(_star_pairs(known, how, salt))
        found = _verified(store(_by_bitmap(stars.distinct(), members, how, turn)), members, docs, how)
        if turn and found.isEmpty():
            break
        labels = store(components(links.union(found)))
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        whole = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        known = whole.join(_mixed(whole).select("token"), "token")
    return labels, whole


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two rows link when the Jaccard similarity of their sets of distinct word
    shingles is at least ``num / den``. Words are runs of other characters than
    white space, with A-Z lower-cased; a text of fewer than ``k`` words is one
    shingle. ``component_id`` is the smallest doc_id that links reach.

    A text that is null, empty or without words has no shingle and links with
    nothing. A row without doc_id links with nothing and has a null
    component_id. Rows that share a doc_id are one point of the graph, each
    with its own links. Other columns are left out. An empty table gives no rows.
    Sets are named by 64-bit hashes.
    """
    how = Similar(k, num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parsed = store(map_partition(docs, lambda b: _sets(b, how), SETS))
    sets = parsed.where("block is null").select("doc_id", "n", "node", "bits")
    counts = token_counters(parsed.where("block is not null").select("block", "counts"))
    filled = sets.where("n > 0 and doc_id is not null")
    lists = store(_short_lists(docs.where("doc_id is not null"), counts, how))
    classes = filled.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")
    )
    members = store(classes.join(lists.select("node").distinct(), "node"))
    # rows that share an id join their nodes
    links = (
        filled.groupBy("doc_id")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least <> most")
        .join(filled.select("doc_id", F.col("node").alias("b")), "doc_id")
        .select(F.col("least").alias("a"), "b")
        .where("a <> b")
    )
    labels, known = _star_links(lists, links, members, docs, how)
    rest = _verified(store(_all_pairs(known, members, how)), members, docs, how)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(rest))
    for done in (lists, members):
        discard(done)
    rooted = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(
        labels, "node", "left"
    )
    rooted = rooted.withColumn("label", F.coalesce("label", "node"))
    roots = (
        rooted.where("n_shingles > 0 and doc_id is not null")
        .groupBy("label")
        .agg(F.min("doc_id").alias("root"))
    )
    lone = F.col("n_shingles") == 0
    return rooted.join(roots, "label", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(lone, F.col("doc_id")).otherwise(F.col("root"))).alias(
            "component_id"
        ),
    )


def _of_node(batch: pa.RecordBatch, how: Similar) -> Iterator[dict]:
    for part, data, offsets in K.chunks(batch):
        owner, hashes = shingle_sets(data, offsets, how.k)
        _, node = set_names(owner, hashes, part.num_rows)
        own = np.flatnonzero(part.column("node").to_numpy() == node.view(np.int64))
        yield {"node": part.column("node").take(own), "text": part.column("text").take(own)}


def near_duplicate_survivors(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Rows of ``docs`` with one document left of each group of near duplicates: that of the smallest doc_id.

    Rows without words, and rows without doc_id, stay. Of rows that repeat the
    kept doc_id all stay. All columns are kept.
    """
    found = jaccard_components(docs, k, num, den)
    dropped = (
        found.where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped_id")).distinct()
    )
    own, back = aside(docs, "doc_id")
    return back(own.join(dropped, F.col("doc_id") == F.col("_dropped_id"), "left_anti"))
