"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node stands for the conversations that begin with the same turns. It is known
by its depth and 128 bits: the exclusive or of a hash of each of its turns with
its place, so that the ids of all prefixes are running sums, which a long
conversation takes over many tasks.

Totals go from children to parents as in time-forward processing. Nodes are
sorted in reverse level order; each takes from a priority queue what its children
have sent, and sends its own total to its parent's place in the order. A queue
that is too long for memory spills sorted runs. Nodes are dealt to shards by
the start of their path, so that most subtrees lie in one shard. A node that is
still waiting for children in other shards stays for the next round, with what
it has got so far, in fewer shards, until the last round links the rest in one.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpweave.llm.frames import crc_of_id, file_system, map_partition, open_input, open_output
from dumpweave.plans.ordered import running_total
from dumpweave.plans.session import discard, store, work_dir

FAMILY, HEADS = 20, 4
#: Nodes of a shard; the last round has one shard of at most as many, if rounds shrink what is left.
SHARD_NODES = 200_000
#: Messages that a queue holds in memory, and of a spilled run.
QUEUE_MESSAGES, RUN_BLOCK = 200_000, 8_192
#: Turns at the start of a path that tell which shard a node goes to.
ROUTE = 8
#: Copies of a row that are numbered at a time, and characters of ids in a row.
COPIES, PIECE_CHARS = 4_096, 1 << 16
NODE = ["depth", "id_a", "id_b"]


# --- conversations --------------------------------------------------------------------


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII blanks."""
    blanks = " \t\n\x0b\x0c\r"
    return F.size(F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), "")).cast("long")


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, said, words) of each turn, and (conv_id, n) of each conversation.

    ``place`` counts from 0 in order of turn, null first; turns of equal number
    are in the order of ``said``, a digest of role and text. Rows that repeat
    are folded first, so that no conversation has to lie in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), said.alias("said"), word_count(text).alias("words")
    )
    folded = turns.groupBy("conv_id", "turn", "said").agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("said")]
    total = store(running_total(folded, order, F.col("copies"), "total"))
    convs = store(total.groupBy("conv_id").agg(F.min("total").alias("first"), F.sum("copies").alias("n")))
    placed = total.join(convs.select("conv_id", "first"), "conv_id").withColumn("place", F.col("total") - F.col("first"))
    blocks = placed.select(
        "conv_id", "place", "said", "words", "copies",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("block"),
    )
    each = F.explode(F.sequence("block", F.least(F.col("block") + COPIES, F.col("copies")) - 1)).alias("copy")
    rows = blocks.select("conv_id", "place", "said", "words", each)
    return rows.select("conv_id", (F.col("place") + F.col("copy")).alias("place"), "said", "words"), convs.select("conv_id", "n")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, said, words) of the rebuilt conversations, and (conv_id, turns) of all of them.

    A conversation starts with the first h turns of the first of its family of
    ``FAMILY`` (as many as that has), h from a crc32 of its id, and goes on with
    its own turns after its first h.
    """
    turns, convs = numbered_turns(conversations)
    turns = store(turns)
    head = F.sort_array(F.collect_list(F.struct("place", "said", "words")))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))  # at most three
    known = convs.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": (crc_of_id(F.col("conv_id")) % HEADS).cast("int")
    })
    known = known.join(heads, "base", "left")
    taken = F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.least("h", F.size("head")))
    known = store(known.withColumn("taken", taken).drop("base"))
    first = known.select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("taken"))).alias("t"))
    first = first.select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.said", "t.words")
    own = turns.join(known.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "said", "words")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return first.union(own), known.select("conv_id", length.cast("long").alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, id_a, id_b, up_a, up_b): the node that each turn leads to, and its parent."""
    marked = turns.select(
        "conv_id", "depth", "words",
        F.xxhash64(F.lit(1), "depth", "said").alias("own_a"), F.xxhash64(F.lit(2), "depth", "said").alias("own_b"),
    )
    ranged = store(marked.repartitionByRange("conv_id", "depth").withColumn("range", F.spark_partition_id()))
    sums = [F.bit_xor(c).alias(c) for c in ("own_a", "own_b")]
    parts = ranged.groupBy("conv_id", "range").agg(*sums)
    # a conversation in several ranges: at most two for each range
    cut = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(cut, "conv_id").select(
        "conv_id", "range", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"before_{c[-1]}") for c in ("own_a", "own_b")]
    )
    inside = Window.partitionBy("range", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"sum_{c}": F.bit_xor(f"own_{c}").over(inside) for c in "ab"})
    summed = summed.join(F.broadcast(carried), ["conv_id", "range"], "left")
    ids = {f"id_{c}": F.col(f"sum_{c}").bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in "ab"}
    summed = summed.withColumns(ids)
    return summed.select(
        "conv_id", "depth", "words", "id_a", "id_b",
        *[F.col(f"id_{c}").bitwiseXOR(F.col(f"own_{c}")).alias(f"up_{c}") for c in "ab"],
    )


# --- digests of the ends --------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Ids of a node, in order, joined to pieces of bounded length."""
    node, first, names, length = None, 0, [], 0
    columns = (*NODE, "first", "names")

    def row() -> dict:
        return dict(zip(columns, [[x] for x in (*node, first, ",".join(names))], strict=True))

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if node is not None and (key != node or length > PIECE_CHARS):
                yield row()
                node = None
            if node is None:
                node, first, names, length = key, conv, [], 0
            names.append(str(conv))
            length += len(names[-1]) + 1
    if node is not None:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The digest of each node's pieces, which come in order."""
    node, digest = None, None
    for batch in batches:
        done: list[list] = []
        for *key, names in zip(*(batch.column(c).to_pylist() for c in (*NODE, "names")), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append([*node, digest.hexdigest()])
                node, digest = key, hashlib.sha256()
            digest.update(names.encode())
        yield dict(zip((*NODE, "ends_sha256"), zip(*done, strict=True) if done else ([], [], [], []), strict=True))
    if node is not None:
        yield dict(zip((*NODE, "ends_sha256"), [[x] for x in (*node, digest.hexdigest())], strict=True))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, id_a, id_b, ends_sha256) of ``ends`` (depth, id_a, id_b, conv_id): of the ascending ids.

    A node's ids are sorted and joined over many tasks; one reads the joined
    pieces, as a digest is made in order.
    """
    ids = "depth long, id_a long, id_b long"
    ordered = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = map_partition(ordered, _pieces, f"{ids}, first long, names string")
    gathered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return map_partition(gathered, _digests, f"{ids}, ends_sha256 string")


# --- time-forward processing ----------------------------------------------------------


class SpillingQueue:
    """Messages (order, sums) for places in an order; taken from the front, put in behind it.

    With more than ``most`` in memory, all are written as a sorted run to a file
    of its own in ``folder``. A run is read again block by block.
    """

    KEY, SUMS = 3, 3

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (first message, number, rest of the run)
        self.paths: list[str] = []

    def put(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        rows, self.heap = np.array(sorted(self.heap), dtype=np.int64), []
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with open_output(path) as out:
            out.write(rows.tobytes())
        self.paths.append(path)
        self._advance(len(self.paths), self._read(path, len(rows)))

    def _read(self, path: str, count: int) -> Iterator[tuple]:
        width = 8 * (self.KEY + self.SUMS)
        with open_input(path) as file:
            for at in range(0, count, RUN_BLOCK):
                raw = file.read_at(min(RUN_BLOCK, count - at) * width, at * width)
                yield from map(tuple, np.frombuffer(raw, dtype=np.int64).reshape(-1, self.KEY + self.SUMS).tolist())

    def _advance(self, number: int, rest: Iterator[tuple]) -> None:
        message = next(rest, None)
        if message is not None:
            heapq.heappush(self.runs, (message, number, rest))

    def first(self) -> tuple | None:
        """The order of the message in front."""
        fronts = [q[0] if q is self.heap else q[0][0] for q in (self.heap, self.runs) if q]
        return min(fronts)[: self.KEY] if fronts else None

    def take(self) -> tuple[tuple, list[int]]:
        """All messages for the place in front, summed."""
        place, sums = self.first(), [0] * self.SUMS
        while self.first() == place:
            if self.heap and self.heap[0][: self.KEY] == place:
                message = heapq.heappop(self.heap)
            else:
                message, number, rest = heapq.heappop(self.runs)
                self._advance(number, rest)
            for i, x in enumerate(message[self.KEY :]):
                sums[i] += x
        return place, sums

    def close(self) -> None:
        for path in self.paths:
            system, plain = file_system(path)
            system.delete_file(plain)


DONE, WAITING, SENT = 0, 1, 2
_OUT = ("state", *NODE, "leaves", "saved", "children")


def forward(folder: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """Totals of a shard's nodes, which come in reverse level order.

    Yields nodes that have heard from all their children, nodes that have not
    (with the number that is missing), and what parents in other shards are to get.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        queue = SpillingQueue(folder, most)
        out: list[tuple] = []

        def send_on(before: tuple | None) -> None:
            # nobody here is at these places
            while (front := queue.first()) is not None and (before is None or front < before):
                (level, a, b), sums = queue.take()
                out.append((SENT, -level, a, b, *sums))

        try:
            for batch in batches:
                names = (*NODE, "up_a", "up_b", "leaves", "saved", "children")
                for depth, a, b, up_a, up_b, leaves, saved, children in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    place = (-depth, a, b)
                    send_on(place)
                    if queue.first() == place:
                        _, (more_leaves, more_saved, heard) = queue.take()
                        leaves, saved, children = leaves + more_leaves, saved + more_saved, children - heard
                    out.append((WAITING if children else DONE, depth, a, b, leaves, saved, children))
                    if not children and depth:
                        queue.put((1 - depth, up_a, up_b, leaves, saved, 1))
                yield dict(zip(_OUT, zip(*out, strict=True), strict=True)) if out else {c: [] for c in _OUT}
                out.clear()
            send_on(None)
            if out:
                yield dict(zip(_OUT, zip(*out, strict=True), strict=True))
        finally:
            queue.close()

    return run


def subtree_totals(nodes: DataFrame, shard_nodes: int | None = None, most: int | None = None) -> DataFrame:
    """(depth, id_a, id_b, leaves, saved): sums over the subtree of each of ``nodes``.

    ``nodes`` has depth, id_a, id_b, up_a, up_b (its parent's), children (their
    number), leaves and saved (its own), and route, an array by which near nodes
    sort near each other. Any route gives the same totals.
    """
    shard_nodes, most = shard_nodes or SHARD_NODES, most or QUEUE_MESSAGES
    folder = work_dir(nodes.sparkSession, "queues")
    ddl = "state int, depth long, id_a long, id_b long, leaves long, saved long, children long"
    left, before, finished = nodes.count(), None, []
    while left:
        shards = -(-left // shard_nodes)
        if before is not None and 2 * left > before:
            shards = 1
        dealt = nodes.coalesce(1) if shards == 1 else nodes.repartitionByRange(shards, "route", *NODE)
        ordered = dealt.sortWithinPartitions(F.desc("depth"), "id_a", "id_b")
        told = store(map_partition(ordered, forward(folder, most), ddl))
        finished.append(told.where(F.col("state") == DONE).select(*NODE, "leaves", "saved"))
        sent = told.where(F.col("state") == SENT).groupBy(*NODE).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.sum("children").alias("heard")
        )
        waiting = told.where(F.col("state") == WAITING).select(*NODE, "leaves", "saved", "children")
        got = {x: F.coalesce(y, F.lit(0)) for x, y in (("leaves", "more_leaves"), ("saved", "more_saved"), ("children", "heard"))}
        waiting = waiting.join(sent, NODE, "left").select(
            *NODE, (F.col("leaves") + got["leaves"]).alias("leaves"), (F.col("saved") + got["saved"]).alias("saved"),
            (F.col("children") - got["children"]).alias("children"),
        )
        nodes = store(nodes.select(*NODE, "up_a", "up_b", "route").join(waiting, NODE))
        before, left = left, nodes.count()
    every = finished[0] if finished else nodes.select(*NODE, "leaves", "saved")
    for more in finished[1:]:
        every = every.union(more)
    return every


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations of (conv_id, turn, role, text).

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Rows without conv_id are
    left out; a null role or text is an empty one; rows that repeat are turns of
    their own; no rows give no nodes. Other columns are left out.
    """
    turns, convs = rebuilt_turns(conversations)
    convs = store(convs)
    paths = store(prefixes(turns))
    none = F.lit(0).cast("long")
    everyone = convs.select("conv_id", none.alias("depth"), none.alias("words"), *[none.alias(c) for c in ("id_a", "id_b", "up_a", "up_b")])
    members = paths.unionByName(everyone)
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("words", "up_a", "up_b")],
    )
    nodes = store(nodes)
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("id_a"), F.col("up_b").alias("id_b")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    route = F.transform(F.sort_array(F.collect_list(F.struct("depth", "id_a"))), lambda x: x["id_a"])
    routes = paths.where(F.col("depth") <= ROUTE).groupBy("conv_id").agg(route.alias("route"))  # at most ROUTE
    full = nodes.join(children, NODE, "left").join(routes, "conv_id", "left")
    full = full.withColumns({
        "n_children": F.coalesce("n_children", none),
        "route": F.slice(F.coalesce("route", F.array().cast("array<bigint>")), F.lit(1), F.least("depth", F.lit(ROUTE)).cast("int")),
    })
    full = store(full)
    totals = subtree_totals(full.select(
        *NODE, "up_a", "up_b", "route", F.col("n_children").alias("children"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ))
    last = convs.select("conv_id", F.col("turns").alias("depth"))
    ends = paths.select("conv_id", *NODE).join(last, ["conv_id", "depth"])
    ends = ends.select(*NODE, "conv_id").union(last.where("depth = 0").select("depth", none, none, "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("id_a").alias("up_a"), F.col("id_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(totals, NODE).join(ends_digest(ends), NODE, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
