"""Language identification by unigrams summed over all segmentations.

The pieces are the byte strings of a fixed public vocabulary, of any length.
Each language has a probability for every piece. A word's probability is the sum, over all ways
to cut it into pieces, of the product of their probabilities: the forward
algorithm, run for all distinct words of a chunk and all languages at once.
The probabilities are learned by expectation-maximisation (forward-backward) on
the words of labelled texts.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import aside, crc_of_id, map_batches, map_partition, once_per_worker, small_table
from dumpweave.plans.session import store

# labelled rows per language that the fit takes, in expectation
FIT_ROWS = 2_000
ROUNDS = 3
# starts of a word at which pieces are looked up at a time; sums are carried on from there
STRETCH_BYTES = 256
# places of words that are summed at a time
GROUP = 200_000
# share of the uniform distribution in every language
SMOOTHING = 1e-3
UNKNOWN = "und"


def read_pieces(path: str) -> list[bytes]:
    """Byte strings of a rank file (base64 and rank in a line).

    All 256 single bytes are among them, so every text has a segmentation.
    """
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted((found | {bytes([b]) for b in range(256)}) - {b""})


class Vocabulary:
    """The pieces, and an index of all beginnings of pieces."""

    def __init__(self, path: str):
        self.pieces = read_pieces(path)
        self.longest = max(map(len, self.pieces))
        number = {piece: i for i, piece in enumerate(self.pieces)}
        inner = {piece[:size] for piece in self.pieces for size in range(1, len(piece))}
        heads = list(inner | number.keys())
        data = np.frombuffer(b"".join(heads), dtype=np.uint8)
        ends = np.cumsum([len(h) for h in heads])
        starts = np.append(0, ends[:-1])
        self.index = K.HashIndex(K.span_hash(K.running_hash(data), starts, ends))
        #: of each beginning the piece that it is, or -1, and whether a longer piece begins with it
        self.piece = np.array([number.get(h, -1) for h in heads], dtype=np.int32)
        self.goes_on = np.array([h in inner for h in heads])

    def __len__(self) -> int:
        return len(self.pieces)


@dataclass
class Stretches:
    """Distinct words of a chunk, longest first: first place and size of each in the running sums.

    ``of_word`` is the word of each occurrence and ``text`` its text.
    """

    vocabulary: Vocabulary
    sums: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    of_word: np.ndarray
    text: np.ndarray


def stretches(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> Stretches:
    """Words of lower-case ASCII and other than white space, whole, each with a blank before it."""
    starts, ends, first = K.word_spans(data, offsets, K.NOT_SPACE)
    owner = K.owners(first)
    _, at, inverse = np.unique(K.span_hash(K.running_hash(data), starts, ends), return_index=True, return_inverse=True)
    sizes = ends[at] - starts[at] + 1
    order = np.argsort(-sizes, kind="stable")
    where = np.empty_like(order)
    where[order] = np.arange(len(order))
    lo, sizes = starts[at][order], sizes[order]
    place = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(own)) - place[own]
    letters = np.where(inside == 0, 0x20, data[lo[own] + np.maximum(inside, 1) - 1]).astype(np.uint8)
    return Stretches(vocabulary, K.running_hash(letters), place, sizes, where[inverse], owner)


@dataclass
class Matches:
    """Pieces that start at places ``begin`` to ``end - 1`` of words, by start and word; ``bounds`` divides the starts."""

    begin: int
    end: int
    row: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    bounds: np.ndarray

    def at(self, start: int) -> slice:
        return slice(self.bounds[start - self.begin], self.bounds[start - self.begin + 1])


def matches(s: Stretches, begin: int) -> Matches:
    """All pieces from the next ``STRETCH_BYTES`` starts on, of any size."""
    end = min(begin + STRETCH_BYTES, int(s.sizes[0]))
    n = int(np.searchsorted(-s.sizes, -begin, side="left"))  # words that are longer than this
    counts = np.minimum(s.sizes[:n], end) - begin
    row = np.repeat(np.arange(n), counts)
    start = begin + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    place, left = s.first[row] + start, s.sizes[row] - start
    live, found, size = np.arange(len(row)), [], 0
    while len(live):
        size += 1
        node = s.vocabulary.index.find(K.span_hash(s.sums, place[live], place[live] + size))
        live, node = live[node >= 0], node[node >= 0]
        piece = s.vocabulary.piece[node]
        own = piece >= 0
        found.append((live[own], np.full(int(own.sum()), size), piece[own]))
        live = live[s.vocabulary.goes_on[node]]
        live = live[left[live] > size]
    which, sizes, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((row[which], start[which]))
    which = which[order]
    bounds = np.searchsorted(start[which], np.arange(begin, end + 1))
    return Matches(begin, end, row[which], sizes[order], pieces[order], bounds)


def forward(s: Stretches, logs: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word, and alpha[i]: that of its first ``i`` bytes, per language.

    Without ``every`` alpha holds only as many of the last places as the longest
    piece has bytes, taken in turn. ``logs`` has a row for each piece.
    """
    longest = int(s.sizes[0])
    depth = longest + 1 if every else min(longest, s.vocabulary.longest) + 1
    alpha = np.full((depth, len(s.sizes), logs.shape[1]), -np.inf)
    alpha[0] = 0.0
    whole = np.empty(alpha.shape[1:])
    ended = len(s.sizes)
    for begin in range(0, longest, STRETCH_BYTES):
        m = matches(s, begin)
        for start in range(m.begin, m.end):
            own = m.at(start)
            row, to = m.row[own], (start + m.size[own]) % depth
            alpha[to, row] = np.logaddexp(alpha[to, row], alpha[start % depth, row] + logs[m.piece[own]])
            live = int(np.searchsorted(-s.sizes, -(start + 1), side="left"))
            whole[live:ended] = alpha[(start + 1) % depth, live:ended]
            ended = live
            if not every:
                alpha[start % depth] = -np.inf
    return whole, alpha


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def _parts(s: Stretches) -> Iterator[tuple[slice, Stretches]]:
    """A bounded number of places at a time, or one longer word."""
    at = 0
    while at < len(s.sizes):
        # shorter words take less room each
        part = slice(at, at + max(1, GROUP // (int(s.sizes[at]) + 1)))
        yield part, Stretches(s.vocabulary, s.sums, s.first[part], s.sizes[part], s.of_word, s.text)
        at = part.stop


def log_probabilities(s: Stretches, p: np.ndarray) -> np.ndarray:
    """Log probability of each distinct word in each language."""
    out, logs = np.zeros((len(s.sizes), p.shape[1])), _logs(p)
    for part, own in _parts(s):
        out[part] = forward(own, logs)[0]
    return out


def expected_counts(s: Stretches, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, per language; ``weights`` counts the words per language."""
    out, logs = np.zeros_like(p), _logs(p)
    for part, own in _parts(s):
        whole, alpha = forward(own, logs, every=True)
        longest = int(own.sizes[0])
        depth = min(longest, s.vocabulary.longest) + 1
        # beta[i]: log probability of the bytes from i on; the next places in turn
        beta = np.zeros((depth, *whole.shape))
        for begin in range((longest - 1) // STRETCH_BYTES * STRETCH_BYTES, -1, -STRETCH_BYTES):
            m = matches(own, begin)
            used = np.empty((len(m.row), p.shape[1]))
            for start in range(m.end - 1, m.begin - 1, -1):
                at = m.at(start)
                row = m.row[at]
                # a word's end has a probability of 1
                after = np.where((start + m.size[at] == own.sizes[row])[:, None], 0.0, beta[(start + m.size[at]) % depth, row])
                through = logs[m.piece[at]] + after
                head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                most = np.maximum.reduceat(through, head)
                sums = np.add.reduceat(np.exp(through - np.repeat(most, np.diff(np.append(head, len(row))), axis=0)), head)
                beta[start % depth, row[head]] = most + np.log(sums)
                used[at] = weights[part][row] * np.exp(alpha[start, row] + through - whole[row])
            for language in range(p.shape[1]):
                out[:, language] += np.bincount(m.piece, weights=used[:, language], minlength=len(p))
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces from expected counts; the row after the last piece stays zero."""
    own = counts[:-1] / np.maximum(counts[:-1].sum(axis=0, keepdims=True), 1e-300)
    p = np.zeros_like(counts)
    p[:-1] = (1 - SMOOTHING) * own + SMOOTHING / len(own)
    p[:-1] /= p[:-1].sum(axis=0, keepdims=True)
    return p


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


@dataclass
class Model:
    path: str
    languages: list[str]
    #: row for each piece and one of zeros, column for each language
    p: np.ndarray
    log_prior: np.ndarray


def fit(labelled: DataFrame, path: str, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``labelled`` (text, lang, and ``key``, which spreads the rows).

    ``fit_rows`` bounds the sample: of each language as many rows in
    expectation, chosen by a hash of ``key``; a language with fewer gives all.
    """
    spark = labelled.sparkSession
    # one row for each language
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    languages, n = [r["lang"] for r in sizes], np.array([r["n"] for r in sizes], dtype=np.float64)
    size = len(read_pieces(path))
    if not languages:
        return Model(path, [], np.zeros((size + 1, 0)), np.zeros(0))
    rates = small_table(
        spark,
        {"lang": languages, "number": range(len(n)), "rate": np.minimum(1.0, fit_rows / n)},
        "lang string, number int, rate double",
    )
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(F.broadcast(rates), "lang").where(drawn < F.col("rate"))
    sample = store(sample.select("text", "number").repartition(spark.sparkContext.defaultParallelism))
    p = smoothed(np.ones((size + 1, len(languages))))
    for _ in range(ROUNDS):
        p = smoothed(_expect(sample, path, spark.sparkContext.broadcast(p)))
    return Model(path, languages, p, np.log(n / n.sum()))


def _expect(sample: DataFrame, path: str, p) -> np.ndarray:
    """Expected uses of the pieces over the sample: one row for each piece, language and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary, own = vocabulary_of(path), p.value
        total = np.zeros_like(own)
        languages = own.shape[1]
        for batch in batches:
            for part, data, offsets in K.chunks(batch):
                s = stretches(K.LOWER[data], offsets, vocabulary)
                language = part.column("number").to_numpy()[s.text]
                weights = np.bincount(
                    s.of_word * languages + language, minlength=len(s.sizes) * languages
                ).reshape(-1, languages)
                total += expected_counts(s, own, weights.astype(np.float64))
        piece, language = np.nonzero(total)
        yield {"piece": piece, "number": language, "uses": total[piece, language]}

    counted = map_partition(sample, count, "piece int, number int, uses double")
    rows = counted.groupBy("piece", "number").agg(F.sum("uses").alias("uses")).toPandas()
    total = np.zeros_like(p.value)
    total[rows["piece"].to_numpy(), rows["number"].to_numpy()] = rows["uses"].to_numpy()
    return total


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of or beside its columns, from ``text`` alone.

    ``score`` is the posterior probability of the language. A text without any
    letter, an empty or null one, and every text if no language was learned, is
    ``und`` with score 0. Of equally likely languages the first by name is taken.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    path, languages = model.path, model.languages
    name = uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    marked = docs.select(*kept, letters.alias("_letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    schema += ", lang_pred string, score double"

    def own(batch: pa.RecordBatch) -> Iterator[dict]:
        vocabulary = vocabulary_of(path)
        p, prior = once_per_worker(name, lambda: (sent.value.p, sent.value.log_prior))
        for part, data, offsets in K.chunks(batch):
            rows = part.num_rows
            columns = {c: part.column(c) for c in part.schema.names}
            best, score = np.full(rows, -1), np.zeros(rows)
            if languages:
                s = stretches(K.LOWER[data], offsets, vocabulary)
                words = log_probabilities(s, p)[s.of_word]
                total = np.stack(
                    [np.bincount(s.text, weights=words[:, i], minlength=rows) for i in range(len(languages))],
                    axis=1,
                )
                total = total + prior
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total[np.arange(rows), best][:, None]).sum(axis=1)
            lettered = part.column("_letters").to_numpy(zero_copy_only=False) & (best >= 0)
            found = [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            yield columns | {"lang_pred": found, "score": np.where(lettered, score, 0.0)}

    return map_batches(marked, own, schema).drop("_letters")


def fit_and_predict(docs: DataFrame, path: str, trained: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) for which ``trained`` is true and lang is known; predict all."""
    labelled = docs.where(trained & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("key")
    )
    return predict(docs, fit(labelled, path, fit_rows))


def in_fold(folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; a row without doc_id is in fold 0."""
    return F.coalesce(crc_of_id(F.col("doc_id").cast("long")) % folds, F.lit(0)) == fold


def held_out_predictions(docs: DataFrame, path: str, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all rows; fold ``held_out`` is not learned from."""
    docs = docs.select("doc_id", "text", "lang")
    found = fit_and_predict(docs, path, ~in_fold(folds, held_out))
    return found.select("doc_id", in_fold(folds, held_out).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, path: str, least_score: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is told with at least this probability; columns as they were."""
    own, back = aside(docs, "doc_id", "text", "lang")
    found = fit_and_predict(own, path, F.lit(True))
    return back(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)))
