"""Token counts that follow edits without encoding a text anew.

A text is cut into leaves of some pieces of the tokenizer's pre-split each; no
token crosses a piece, so a text's count is the sum over its leaves. The leaves'
lengths and counts are kept with sums over pairs, pairs of pairs and so on. An
edit takes the leaves it touches and the context in which the pre-split may
change, encodes these, and updates the sums above them. It stops at the first
leaf whose end is a boundary in the new text too: from there on the text and
so the pieces are the old ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import map_batches
from dumpweave.llm.pretokens import PieceEncoder, encoder

LEAF_PIECES = 8
# code points that the pre-split looks ahead of a boundary
AHEAD = 4
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<start:int,removed:int,inserted:string>>"


class CountTree:
    """Sums of code points and tokens over leaves; node 1 is the root, leaves start at ``width``."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = max(len(chars), 1)
        self.width = 1 << (self.leaves - 1).bit_length()
        rows = np.zeros((2 * self.width, 2), dtype=np.int64)
        if chars:
            rows[self.width : self.width + len(chars)] = np.column_stack([chars, tokens])
        level = self.width
        while level > 1:
            half = level // 2
            rows[half:level] = rows[level : 2 * level].reshape(half, 2, 2).sum(axis=1)
            level = half
        self.nodes = rows.tolist()

    @property
    def chars(self) -> int:
        return self.nodes[1][0]

    @property
    def tokens(self) -> int:
        return self.nodes[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` (the last one from the end on) and its start."""
        node, start = 1, 0
        if at >= self.chars:
            at = max(self.chars - 1, 0)
        while node < self.width:
            node *= 2
            if at - start >= self.nodes[node][0]:
                start += self.nodes[node][0]
                node += 1
        return node - self.width, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more = (chars - self.nodes[node][0], tokens - self.nodes[node][1])
        while node:
            self.nodes[node][0] += more[0]
            self.nodes[node][1] += more[1]
            node //= 2

    def leaf(self, number: int) -> list[int]:
        return self.nodes[number + self.width]

    def as_struct(self) -> dict:
        rows = self.nodes[self.width : self.width + self.leaves]
        return {"chars": [r[0] for r in rows], "tokens": [r[1] for r in rows]}


def _trees(bpe: PieceEncoder, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """Leaves of the texts of a chunk. A text that is not split here is one leaf."""
    p = bpe.pieces(data, offsets)
    counts = np.append(0, np.cumsum(bpe.sizes[p.place]))
    ends = np.append(p.starts, len(p.text) if len(p.starts) else 0)
    whole = iter(bpe.encode_whole([p.text[p.first[i] : p.first[i + 1]] for i in np.flatnonzero(p.whole)]))
    found = []
    for row in range(len(offsets) - 1):
        if p.whole[row]:
            found.append({"chars": [int(p.first[row + 1] - p.first[row])], "tokens": [len(next(whole))]})
            continue
        lo, hi = p.by_text[row], p.by_text[row + 1]
        cuts = np.append(np.arange(lo, hi, LEAF_PIECES), hi)
        places = np.append(ends[cuts[:-1]], p.first[row + 1])
        found.append({"chars": np.diff(places).tolist(), "tokens": np.diff(counts[cuts]).tolist()})
    return found


class _Edit:
    """One edit of one text: the leaves it takes, and the text to encode for them."""

    def __init__(self, tree: CountTree, text: str, start: int, removed: int, inserted: str):
        self.tree, self.text = tree, text
        self.start = min(max(start, 0), len(text))
        self.removed = min(max(removed, 0), len(text) - self.start)
        self.inserted = inserted
        self.lo, self.begin = tree.find(max(self.start - 1, 0))
        # a piece that ends at most two code points before the edit may change
        while self.begin > 0 and self.begin + 2 > self.start:
            self.lo, self.begin = tree.find(self.begin - 1)
        self.hi, first = tree.find(max(self.start + self.removed - 1, self.start))
        self.end = first + tree.leaf(self.hi)[0]

    def region(self) -> str:
        """New text of the leaves, and what the pre-split may look at behind them."""
        self.new = self.text[self.begin : self.start] + self.inserted + self.text[self.start + self.removed : self.end]
        ahead = self.tree.leaf(self.hi + 1)[0] if self.hi + 1 < self.tree.leaves else 0
        return self.new + self.text[self.end : self.end + ahead + AHEAD]

    def widen(self) -> None:
        self.hi += 1
        self.end += self.tree.leaf(self.hi)[0]

    def at_end(self) -> bool:
        return self.end >= len(self.text)

    def settle(self, tokens: int) -> str:
        """Update the sums; returns the edited text."""
        self.tree.set(self.lo, len(self.new), tokens)
        for leaf in range(self.lo + 1, self.hi + 1):
            self.tree.set(leaf, 0, 0)
        return self.text[: self.begin] + self.new + self.text[self.end :]


def _edited(bpe: PieceEncoder, texts: list[str], trees: list[CountTree], edits: list[list[dict]]):
    """Texts and trees after all edits, and the code points that were encoded.

    The last edits of all texts are made first, in one go, then the ones before.
    """
    texts, encoded = list(texts), np.zeros(len(texts), dtype=np.int64)
    waiting = [sorted((x for x in e or () if x is not None), key=lambda x: x["start"] or 0) for e in edits]
    while any(waiting):
        open_ = {
            row: _Edit(trees[row], texts[row], e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
            for row, rest in enumerate(waiting)
            if rest
            for e in [rest.pop()]
        }
        while open_:
            rows = list(open_)
            regions = [open_[r].region() for r in rows]
            data, offsets = K.utf8(pa.array(regions, pa.large_string()))
            p = bpe.pieces(data, offsets)
            counts = np.append(0, np.cumsum(bpe.sizes[p.place]))
            for i, row in enumerate(rows):
                edit = open_[row]
                encoded[row] += len(regions[i])
                if p.whole[i]:
                    # not split here: the text becomes one leaf
                    edit.lo, edit.begin, edit.hi, edit.end = 0, 0, edit.tree.leaves - 1, len(edit.text)
                    edit.region()
                    texts[row] = edit.settle(len(bpe.encode_whole([edit.new])[0]))
                    encoded[row] += len(edit.new)
                    del open_[row]
                    continue
                lo, hi = p.by_text[i], p.by_text[i + 1]
                stop = p.first[i] + len(edit.new)
                cut = lo + int(np.searchsorted(p.starts[lo:hi], stop))
                if edit.at_end() or (cut < hi and p.starts[cut] == stop):
                    texts[row] = edit.settle(int(counts[cut] - counts[lo]))
                    del open_[row]
                else:
                    edit.widen()
    return texts, encoded


def with_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (text and other columns) with ``tree``: code points and tokens of each leaf.

    The leaves are what has to be kept; sums above them follow. A null or empty
    text has a tree without tokens.
    """

    def build(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = encoder(tokenizer)
        for part, data, offsets in K.chunks(batch):
            yield {c: part.column(c) for c in part.schema.names} | {"tree": _trees(bpe, data, offsets)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, build, f"{schema}, tree {TREE}")


def with_token_counts(docs: DataFrame, tokenizer: str, name: str = "n_tokens") -> DataFrame:
    """``docs`` (text and other columns) with the number of each text's tokens; 0 for a null or empty one."""

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = encoder(tokenizer)
        for part, data, offsets in K.chunks(batch):
            yield {c: part.column(c) for c in part.schema.names} | {name: bpe.counts(data, offsets)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, count, f"{schema}, `{name}` long")


def apply_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Apply the ``edits`` of each row of ``docs`` (text, tree, edits, and other columns).

    An edit removes ``removed`` code points from ``start`` on and puts
    ``inserted`` there; places are those of the text before any edit, and the
    edits of a row do not overlap. Places outside the text are moved to its ends.
    ``text`` and ``tree`` come back edited, with ``n_tokens`` before,
    ``n_tokens_edited`` after, and ``n_encoded``, the code points that were
    encoded again. A null text is an empty one; null edits are none, alone or among
    others. A null start or number is 0, a null insertion empty.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = encoder(tokenizer)
        for part, _, _ in K.chunks(batch):
            trees = [CountTree(t["chars"], t["tokens"]) for t in part.column("tree").to_pylist()]
            before = [t.tokens for t in trees]
            texts = [t or "" for t in part.column("text").to_pylist()]
            texts, encoded = _edited(bpe, texts, trees, part.column("edits").to_pylist())
            yield {c: part.column(c) for c in part.schema.names} | {
                "text": texts,
                "tree": [t.as_struct() for t in trees],
                "n_tokens": before,
                "n_tokens_edited": [t.tokens for t in trees],
                "n_encoded": encoded,
            }

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{schema}, n_tokens long, n_tokens_edited long, n_encoded long")


def count_after_edits(docs: DataFrame, tokenizer: str, edits) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_encoded) of every row of ``docs`` (doc_id, text).

    ``edits`` is a column of edits made from the row. Repeated rows each give a
    row; other columns are left out; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("edits", edits.cast(EDITS))
    found = apply_edits(with_trees(rows, tokenizer), tokenizer)
    return found.select(
        "doc_id", "n_tokens", "n_tokens_edited", F.length("text").cast("long").alias("n_chars_edited"), "n_encoded"
    )
