"""Pieces that a byte-level BPE tokenizer splits a text into, and their token ids.

No merge crosses such a piece, so the ids of a text are those of its pieces in
a row. Pieces are found for a whole chunk of texts at once; the tokenizer
encodes each distinct piece that a worker has not met yet. The rule is the
usual pattern of byte-level BPE:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Texts with a code point whose category is not the same in all versions of
Unicode since 3.2, or beyond the basic plane, and texts that spell an added
token, go through the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np

from dumpweave.llm import kernels as K

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
# white space of the pattern
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# distinct pieces that a worker remembers before it starts anew
REMEMBERED = 600_000


@cache
def code_point_classes() -> np.ndarray:
    old = unicodedata.ucd_3_2_0
    classes = np.full(0x10001, UNSURE, dtype=np.uint8)
    for code in range(0x10000):
        category = unicodedata.category(chr(code))
        if category != "Cn" and category == old.category(chr(code)):
            classes[code] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
    classes[WHITE] = SPACE
    classes[0xD800:0xE000] = UNSURE
    return classes


@cache
def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


def piece_starts(points: np.ndarray, classes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places at which pieces start, given code points, their classes and the texts' first places."""
    n = len(points)
    head = np.zeros(n + 1, dtype=bool)
    head[heads] = True
    head[n] = True
    tail = head[1:]  # last place of a text
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = UNSURE, classes[:-1]
    before[head[:-1]] = UNSURE
    white = classes == SPACE
    blank = points == 0x20
    start = (classes != before) | head[:-1]
    # a blank before other than white space belongs to what follows
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1]
    start &= ~(after_blank & ~white & (before == SPACE))
    # white space of two or more leaves its last place to what follows
    next_text = np.zeros(n, dtype=bool)
    next_text[:-1] = ~white[1:]
    start |= white & next_text & ~tail
    # contractions
    mark = np.flatnonzero((points == 0x27) & ~tail)
    if len(mark):
        mark = mark[(before[mark] != OTHER) & ~((before[mark] == SPACE) & after_blank[mark])]
        one = points[mark + 1]
        two = np.where(tail[mark + 1], 0, points[np.minimum(mark + 2, n - 1)])
        size = np.zeros(len(mark), dtype=np.int64)
        for letter in "stmd":
            size[one == ord(letter)] = 2
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        long = mark[size == 3]
        start[long + 2] = False
        end = mark + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Token ids of texts by way of their pieces, remembered within a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.index = K.GrowingIndex()
        self.sizes = np.zeros(1 << 16, dtype=np.int32)
        self.offsets = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and ids one piece after the other."""
        merge, alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        blank = chr(alphabet[0x20])
        sizes, ids = [], []
        for piece in pieces:
            if piece.isascii() and piece.isprintable():
                own = merge(piece.replace(" ", blank))
            else:
                own = merge(piece.encode().decode("latin-1").translate(alphabet))
            sizes.append(len(own))
            ids.extend([t.id for t in own])
        return np.array(sizes, dtype=np.int32), np.array(ids, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        sizes, flat = self._encode_pieces(pieces)
        lo = self.index.add(hashes)
        hi = lo + len(hashes)
        while hi > len(self.sizes):
            self.sizes, self.offsets = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.offsets))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.sizes[lo:hi] = sizes
        self.offsets[lo:hi] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Pieces:
        """Pieces of the texts of a chunk; ``whole`` are texts that have none here."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # places of texts in code points: bytes that do not continue one
        lead = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        first = lead[offsets]
        if first[-1] != len(points):  # not UTF-8
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            text = "".join(texts)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = code_point_classes()[np.minimum(points, 0x10000)]
        rows = len(offsets) - 1
        whole = np.zeros(rows, dtype=bool)
        unsure = np.flatnonzero(classes == UNSURE)
        whole[np.searchsorted(first, unsure, side="right") - 1] = True
        for added in self.added:
            at = text.find(added)
            while at >= 0:
                whole[np.searchsorted(first, at, side="right") - 1] = True
                at = text.find(added, at + 1)
        heads = first[:-1][first[:-1] < len(points)]
        if len(points):
            starts = piece_starts(points, classes, heads)
        else:
            starts = np.zeros(0, dtype=np.int64)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        by_text = np.searchsorted(starts, first)
        sums = np.zeros(len(points) + 1, dtype=K.U64)
        np.cumsum(K.mix(points + K.U64(77)) * K.powers(len(points) + 1)[0][: len(points)], out=sums[1:])
        hashes = K.span_hash(sums, starts, ends)
        place = self.index.find(hashes)
        if (place < 0).any():
            if len(self.index) > REMEMBERED:
                self.forget()
                place[:] = -1
            missing = np.flatnonzero(place < 0)
            unseen, where = np.unique(hashes[missing], return_index=True)
            spans = zip(starts[missing[where]].tolist(), ends[missing[where]].tolist(), strict=True)
            self._learn(unseen, [text[s:e] for s, e in spans])
            place[missing] = self.index.find(hashes[missing])
        return Pieces(text, first, starts, ends, by_text, place, whole)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and ``n + 1`` offsets into them."""
        p = self.pieces(data, offsets)
        sizes = self.sizes[p.place].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.offsets[p.place] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.append(0, ends)[p.by_text]
        if p.whole.any():
            parts, rows = [], np.flatnonzero(p.whole)
            found = iter(self.encode_whole([p.text[p.first[i] : p.first[i + 1]] for i in rows]))
            for i in range(len(offsets) - 1):
                own = next(found) if p.whole[i] else ids[bounds[i] : bounds[i + 1]]
                parts.append(np.asarray(own, dtype=np.uint32))
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        p = self.pieces(data, offsets)
        found = np.diff(np.append(0, np.cumsum(self.sizes[p.place], dtype=np.int64))[p.by_text])
        rows = np.flatnonzero(p.whole)
        if len(rows):
            found[rows] = [len(x) for x in self.encode_whole([p.text[p.first[i] : p.first[i + 1]] for i in rows])]
        return found


class Pieces:
    """Pieces of a chunk: spans in code points, first piece of each text, place in the encoder."""

    def __init__(self, text, first, starts, ends, by_text, place, whole):
        self.text, self.first, self.starts, self.ends = text, first, starts, ends
        self.by_text, self.place, self.whole = by_text, place, whole


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
