"""Scoring with a language model of deleted interpolation.

Words, word bigrams and word trigrams are counted over all training documents:

    p(w | u v) = l3 C(u v w) / C(u v) + l2 C(v w) / C(v) + l1 c(w) / N + l0 (c(w) + 1) / (N + V + 1)

Where a context has not been seen, an order's estimate is that of the order
below, so that each order is a distribution over all words. The weights l depend
on how often the context u v was seen. They are learned by
expectation-maximisation on the held-out part of the training documents, with
estimates from the counts of the other part.

Texts are numbered once into blocks. A block asks for the counts of its distinct
n-grams: they travel as sorted hashes, in the bin of their hash, and the bin's
sums come back in the same order, without the hashes. Trigrams go second, and
only those whose two bigrams other blocks hold as well: all others occur in no
other block, which so knows their counts. No table of trigrams is ever made, and
a text is scored where its block lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dumpweave.llm import kernels as K
from dumpweave.llm.frames import crc_of_id, map_partition, to_batch
from dumpweave.plans.session import discard, store

# tokens of a block, which has whole texts; no limit of the model
HEAD = 1 << 19
# n-grams of a bin, copies in several blocks included
BIN_KEYS = 1 << 21
# bit lengths of a 64-bit count, and one for none
BUCKETS = 64
EM_ROUNDS = 30
# weights of trigram, bigram, unigram and base where nothing is held out
DEFAULT = (0.0, 0.3, 0.6, 0.1)
END = K.mix(np.array([0xE0D0], dtype=K.U64))[0]

_BLOCK = (
    "block long, doc_id array<long>, trained array<boolean>, held array<boolean>, sizes array<long>, "
    "words binary, places binary, n_trained long, n_held long, n_tokens long, n_words long"
)
_REQUEST = "n int, bin int, block long, keys binary, c binary, held binary"
_ANSWER = "n int, bin int, block long, c binary, held binary, known long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and ``n + 1`` offsets."""
    lower = K.LOWER[data]
    starts, ends, first = K.word_spans(lower, offsets, K.NOT_SPACE)
    words = K.span_hash(K.running_hash(lower), starts, ends)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def _pack(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, so that leading zeros take next to nothing."""
    planes = np.ascontiguousarray(values.astype(K.U64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(K.U64).ravel()


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=K.U64)


def token_blocks(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, trained, held) in blocks: their tokens as places in the block's own words."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task, n, waiting, parts = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for part, data, offsets in K.chunks(batch):
                hashes, first = tokens(data, offsets)
                parts.append((hashes, np.diff(first), *(part.column(x).to_pylist() for x in ("doc_id", "trained", "held"))))
                waiting += len(hashes)
                if waiting >= HEAD:
                    yield _block((task << 32) + n, parts)
                    n, waiting, parts = n + 1, 0, []
        if parts:
            yield _block((task << 32) + n, parts)

    def _block(block: int, parts: list[tuple]) -> dict:
        words, places = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = np.concatenate([p[1] for p in parts])
        doc_id, trained, held = ([x for p in parts for x in p[i]] for i in (2, 3, 4))
        row = {
            "block": block, "doc_id": doc_id, "trained": trained, "held": held, "sizes": sizes,
            "words": _pack(np.diff(words, prepend=K.U64(0))), "places": _pack(places),
            "n_trained": int(sizes[np.array(trained)].sum()), "n_held": int(sizes[np.array(trained) & held].sum()),
            "n_tokens": len(places), "n_words": len(words),
        }
        return {name: [value] for name, value in row.items()}

    return map_partition(docs.select("doc_id", "text", "trained", "held"), blocks, _BLOCK)


class Grams:
    """The distinct n-grams of a block: sorted hashes, their counts here, and each token's place among them."""

    def __init__(self, hashes: np.ndarray, block: Block):
        self.keys, self.place = np.unique(hashes, return_inverse=True)
        self.c, self.held = (np.bincount(self.place, x, len(self.keys)).astype(np.int64) for x in (block.trained, block.held))

    def requests(self, n: int, block: int, bins: int, wanted: np.ndarray | slice = slice(None)) -> list[dict]:
        """A row for each bin that has some of the ``wanted`` n-grams."""
        keys, c, held = self.keys[wanted], self.c[wanted], self.held[wanted]
        of = ((keys >> K.U64(32)) * K.U64(bins) >> K.U64(32)).astype(np.int64)
        cuts = np.searchsorted(of, np.arange(bins + 1))
        return [
            {"n": n, "bin": b, "block": block, "keys": _pack(np.diff(keys[lo:hi], prepend=K.U64(0))),
             "c": _pack(c[lo:hi]), "held": _pack(held[lo:hi])}
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi
        ]

    def take(self, answers: list[dict], wanted: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Put the counts of all blocks in; whether other blocks have the ``wanted`` n-grams."""
        answers = sorted(answers, key=lambda x: x["bin"])
        c, held = (_joined([_unpack(x[name]) for x in answers]).astype(np.int64) for name in ("c", "held"))
        self.c[wanted] = np.where(c > 0, c - 1, self.c[wanted])
        self.held[wanted] = np.where(c > 0, held, self.held[wanted])
        return c > 0


class Block:
    """The tokens of a block, and whether they count."""

    def __init__(self, row: dict):
        self.id, self.doc_id, self.sizes = row["block"], row["doc_id"], np.array(row["sizes"])
        self.first = np.cumsum(self.sizes) - self.sizes
        trained = np.array(row["trained"])
        self.trained, self.held = (np.repeat(x, self.sizes) for x in (trained, trained & row["held"]))
        self.words = np.cumsum(_unpack(row["words"]), dtype=K.U64)
        self.w = self.words[_unpack(row["places"]).astype(np.int64)]
        # ends before a text
        self.v = np.append(END, self.w[:-1])
        self.v[self.first] = END
        self.u = np.append(END, self.v[:-1])
        self.u[self.first] = END
        self.starts = np.zeros(len(self.w), dtype=bool)
        self.starts[self.first] = True

    def grams(self, n: int) -> Grams:
        """n-grams that end at each token."""
        if n == 1:
            return Grams(self.w, self)
        total = self.v * K.WORD_CODES[0] + self.w * K.WORD_CODES[1]
        return Grams(K.mix(total if n == 2 else K.mix(self.u) * K.WORD_CODES[2] + total), self)

    def wanted(self, two: Grams, shared: np.ndarray, three: Grams) -> np.ndarray:
        """Trigrams that other blocks may have: those whose bigrams they have."""
        here = shared[two.place]
        before = np.append(True, here[:-1]) | self.starts
        wanted = np.zeros(len(three.keys), dtype=bool)
        wanted[three.place[here & before]] = True
        return wanted


def _answers(requests: DataFrame) -> DataFrame:
    """What all blocks together have of each n-gram, to every block that asked; 0 for what it alone has.

    Counts are one more than they are, to tell them from that. ``known`` of a
    bin's rows adds up to its distinct n-grams with a count.
    """
    schema = to_arrow_schema(StructType.fromDDL(_ANSWER))

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.select(["n", "bin", "block"]).to_pydict()
        keys = [np.cumsum(_unpack(x.as_py()), dtype=K.U64) for x in asked["keys"]]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        c, held = (
            np.bincount(place, np.concatenate([_unpack(x.as_py()) for x in asked[name]]), len(distinct)).astype(np.int64)
            for name in ("c", "held")
        )
        shared = np.bincount(place, minlength=len(distinct)) > 1
        found = [np.split(np.where(shared, x, 0)[place], cuts) for x in (c + 1, held)]
        packed = {name: [_pack(x) for x in parts] for name, parts in zip(("c", "held"), found, strict=True)}
        known = [int((c > 0).sum()), *[0] * (len(keys) - 1)]
        return pa.Table.from_batches([to_batch(rows | packed | {"known": known}, schema)])

    return requests.groupBy("n", "bin").applyInArrow(answer, _ANSWER)


def _by_block(blocks: DataFrame, answers: DataFrame, function, ddl: str) -> DataFrame:
    """``function`` of a Block and its answers by n; it gives a dict of columns."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        given: dict[int, list[dict]] = {1: [], 2: [], 3: []}
        for row in answers.to_pylist():
            given[row["n"]].append(row)
        return pa.Table.from_batches([to_batch(function(Block(row), given), schema) for row in rows.to_pylist()], schema)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)


def _columns(rows: list[dict]) -> dict:
    return {name: [row[name] for row in rows] for name in ("n", "bin", "block", "keys", "c", "held")}


def block_counts(blocks: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The counts of each block's n-grams as answers; then all training tokens, those held out, and distinct words."""
    sums = blocks.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_trained", "n_held", "n_tokens", "n_words")])
    total, held, n_tokens, n_words = sums.first()
    bins = {1: n_words // BIN_KEYS + 1, 2: n_tokens // BIN_KEYS + 1, 3: n_tokens // BIN_KEYS + 1}

    def words_and_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for n in (1, 2):
                    yield _columns(block.grams(n).requests(n, block.id, bins[n]))

    def shared_trigrams(block: Block, given: dict) -> dict:
        two, three = block.grams(2), block.grams(3)
        wanted = block.wanted(two, two.take(given[2]), three)
        return _columns(three.requests(3, block.id, bins[3], wanted))

    short = store(_answers(map_partition(blocks, words_and_bigrams, _REQUEST)))
    long = store(_answers(_by_block(blocks, short.where("n = 2"), shared_trigrams, _REQUEST)))
    distinct = short.where("n = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    return short.union(long), total, held, distinct


def token_counts(block: Block, given: dict) -> dict[str, np.ndarray]:
    """For each token ``c3`` of its trigram, ``cuv`` of that one's context, ``c2`` of the bigram, ``cv`` of
    its context, ``c1`` of the word; ``h3`` to ``h1`` are the held-out parts.

    A token before another is followed by one each time, so that a context's
    count is that of its own n-gram; before a text there are as many ends as texts.
    """
    one, two, three = (block.grams(n) for n in (1, 2, 3))
    wanted = block.wanted(two, two.take(given[2]), three)
    one.take(given[1])
    three.take(given[3], wanted)
    end = np.searchsorted(one.keys, END)
    found = {}
    for name in ("c", "held"):
        first = name[0]
        for n, grams in enumerate((one, two, three), 1):
            found[f"{first}{n}"] = getattr(grams, name)[grams.place]
        for context, n in (("v", 1), ("uv", 2)):
            before = np.append(0, found[f"{first}{n}"][:-1])
            found[f"{first}{context}"] = np.where(block.starts, getattr(one, name)[end], before)
    return found


def estimates(c3: Column, cuv: Column, c2: Column, cv: Column, c1: Column, total: int, distinct: int) -> list[Column]:
    """Probabilities by trigram, bigram, unigram and base."""
    base = (c1 + 1) / F.lit(float(total + distinct + 1))
    one = c1 / F.lit(float(total)) if total else base
    two = F.when(cv > 0, c2 / cv).otherwise(one)
    return [F.when(cuv > 0, c3 / cuv).otherwise(two), two, one, base]


def bucket_of(context: Column) -> Column:
    """Bit length of a context's count; 0 for none."""
    return F.when(context > 0, F.length(F.bin(context))).otherwise(0)


_EVENT = ("c3", "cuv", "c2", "cv", "c1")
_EVENTS = ", ".join(f"{c} long" for c in (*_EVENT, "n"))


def held_out_events(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(c3, cuv, c2, cv, c1, n): the other part's counts for all held-out tokens; equal ones are one row."""

    def events(block: Block, given: dict) -> dict:
        found = token_counts(block, given)
        rows = np.stack([(found[c] - found["h" + c[1:]])[block.held] for c in _EVENT])
        order = np.lexsort(rows)
        rows = rows[:, order]
        new = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))[: rows.shape[1]])
        return {**dict(zip(_EVENT, rows[:, new], strict=True)), "n": np.diff(np.append(new, rows.shape[1]))}

    return _by_block(blocks, answers, events, _EVENTS).groupBy(*_EVENT).agg(F.sum("n").alias("n"))


def event_estimates(events: DataFrame, total: int, distinct: int) -> DataFrame:
    """(bucket, p0 .. p3, n) of events."""
    found = estimates(*map(F.col, _EVENT), total, distinct)
    return events.select(bucket_of(F.col("cuv")).alias("bucket"), *[p.alias(f"p{i}") for i, p in enumerate(found)], "n")


def mixed(weights: np.ndarray, found: list[Column], bucket: Column) -> list[Column]:
    """The weighted estimates."""
    return [F.lit(weights[:, i].tolist())[bucket] * p for i, p in enumerate(found)]


def learned_weights(events: DataFrame) -> np.ndarray:
    """Per bucket the weights of trigram, bigram, unigram and base, by expectation-maximisation.

    A round is one pass over the events; a bucket gives one row.
    """
    weights, learned = np.full((BUCKETS, 4), 0.25), np.zeros(BUCKETS, dtype=bool)
    for _ in range(EM_ROUNDS):
        own = mixed(weights, [F.col(f"p{i}") for i in range(4)], F.col("bucket"))
        shares = events.select("bucket", "n", *[x.alias(f"s{i}") for i, x in enumerate(own)])
        whole = F.col("s0") + F.col("s1") + F.col("s2") + F.col("s3")
        sums = shares.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"s{i}") / whole).alias(f"s{i}") for i in range(4)])
        for row in sums.collect():
            found = np.array(row[1:])
            weights[row["bucket"]] = found / found.sum()
            learned[row["bucket"]] = True
    for bucket in range(BUCKETS):
        if not learned[bucket]:
            weights[bucket] = weights[bucket - 1] if bucket else DEFAULT
        # every word must stay possible
        weights[bucket] = (weights[bucket] + 1e-6) / (weights[bucket] + 1e-6).sum()
    return weights


def score_texts(docs: DataFrame, trained: Column, held: Column) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) under a model of those for which ``trained`` is true.

    ``held`` marks the training rows whose counts set the weights. Columns:
    doc_id, n_tokens, n_known, train_tokens, base_score, score. Both scores are
    sums of log10 probabilities over the text's words and one end.

    A null text is an empty one: it has the end only. Repeated rows each count
    and each get their scores. Other columns are left out. Without training rows
    every token is unknown and the base is 1 for each; an empty table gives no rows.
    Words and n-grams are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), trained.alias("trained"), held.alias("held"))
    blocks = store(token_blocks(docs))
    answers, total, total_held, distinct = block_counts(blocks)
    events = store(held_out_events(blocks, answers))
    weights = learned_weights(event_estimates(events, total - total_held, distinct))
    discard(events)

    def scores(block: Block, given: dict) -> dict:
        found = token_counts(block, given)
        c3, cuv, c2, cv, c1 = (found[c].astype(np.float64) for c in _EVENT)
        base = (c1 + 1) / (total + distinct + 1)
        one = c1 / total if total else base
        two = np.where(cv > 0, c2 / np.maximum(cv, 1), one)
        three = np.where(cuv > 0, c3 / np.maximum(cuv, 1), two)
        # the bit length of the context's count
        own = weights[np.frexp(cuv)[1]]
        mixture = own[:, 0] * three + own[:, 1] * two + own[:, 2] * one + own[:, 3] * base
        by_text = {"n_known": (c1 > 0).astype(np.int64), "base_score": np.log10(base), "score": np.log10(mixture)}
        sums = {name: np.add.reduceat(x, block.first) for name, x in by_text.items()}
        return {"doc_id": block.doc_id, "n_tokens": block.sizes, "train_tokens": np.full(len(block.sizes), total), **sums}

    return _by_block(
        blocks, answers, scores,
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def held_out_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, tuning: int = 3) -> DataFrame:
    """Scores of all documents by a model that learns from those outside a fold.

    The fold of a row is crc32(doc_id as text) mod ``folds``; rows of fold
    ``held_out`` are scored only, those of ``tuning`` set the mixture's weights.
    A row without doc_id is in fold 0.
    """
    fold = F.coalesce(crc_of_id(F.col("doc_id").cast("long")) % folds, F.lit(0))
    scores = score_texts(docs, fold != held_out, fold == tuning)
    own = F.coalesce(crc_of_id(F.col("doc_id")) % folds, F.lit(0)) == held_out
    return scores.select("doc_id", own.alias("held_out"), *scores.columns[1:])
