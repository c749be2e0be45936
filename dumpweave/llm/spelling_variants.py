"""Spelling variants of words by an index of variable-length grams.

Words one edit apart are found through grams of two to four characters. A gram
is extended while it is frequent among the words, so that the dictionary holds
long grams where short ones would have long lists. A word is decomposed into the
longest dictionary grams at its places, without those inside another.

An edit at a place can touch the grams around it only: those that hold it, those
left of it that could have grown over it, and those right of it that a gram from
its left could have swallowed. All other grams of a word are also grams of each
word that comes of this edit, at the same distance from the start (left of the
edit) or from the end (right of it). So for every place the lists of the last
gram left untouched and the first one on the right are merged: words are joined
on what these two reach over, and on the length. An edit that leaves no gram
untouched is looked up by the whole rest of the word. What lies between the two
grams is compared at last; there the candidates must differ by exactly one edit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.llm.frames import map_batches
from dumpweave.plans.ordered import global_index
from dumpweave.plans.session import discard, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST_GRAM, LONGEST_GRAM = 2, 4
#: A gram is frequent if it makes up more than one in so many of the grams of its length. There are
#: fewer frequent grams of a length than this, and the dictionary adds one character to them.
FREQUENT = 512
START, END = "\x01", "\x02"
#: Words that the kernel takes at a time, in characters.
CHUNK_CHARS = 1 << 18


# --- words ----------------------------------------------------------------------------


def words_of(docs: DataFrame, garble: int | None, least_chars: int, least_count: int) -> DataFrame:
    """(word, n): the runs of letters of ``docs`` (doc_id, text) and how often they occur.

    Only A-Z are lower-cased. With ``garble``, a run loses one code point where
    that number divides the crc32 of "<doc_id>:<run>" (a null id is written as
    nothing). Words of fewer than ``least_chars`` code points or ``least_count``
    occurrences are left out. Occurrences are summed in the map tasks first.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    # a shorter run does not get longer
    runs = F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{max(least_chars, 1)},}}"), F.lit(0))
    rows = docs.select(doc_id.alias("doc"), F.explode(runs).alias("run"))
    word: Column = F.col("run")
    if garble:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        cut = (h % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
        word = F.when(h % garble == 0, shorter).otherwise(word)
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_chars))


# --- dictionary -----------------------------------------------------------------------


@dataclass
class Grams:
    """Frequent grams, and what grams of the dictionary end with; by length, as sorted numbers."""

    frequent: dict[int, np.ndarray]
    endings: dict[int, np.ndarray]


def gram_dictionary(words: DataFrame, shortest: int, longest: int, frequent: int) -> Grams:
    """The dictionary of ``words`` (word), by the numbers of grams in all of them.

    It holds all grams of ``shortest`` characters and those up to ``longest``
    whose beginning, one shorter, is frequent. At most ``frequent`` beginnings
    of a length are, and a gram adds one of a hundred characters: this bounds
    what reaches the driver and the tasks.
    """
    padded = F.concat(F.lit(START), F.col("word"), F.lit(END))
    places = words.select(padded.alias("s"), F.explode(F.sequence(F.lit(1), F.length("word") + 3 - shortest)).alias("at"))
    sizes = range(shortest, longest + 1)
    found = places.select(F.explode(F.array(*[F.col("s").substr(F.col("at"), F.lit(q)) for q in sizes])).alias("gram"), "s", "at")
    # at the end of a word the longer ones are not there
    counts = found.groupBy("gram", F.length("gram").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    counts = store(counts)
    totals = counts.groupBy("q").agg(F.sum("n").alias("total"))
    often = counts.join(F.broadcast(totals), "q").where(F.col("n") * frequent > F.col("total")).where(F.col("q") < longest)
    often = often.select(F.col("gram").alias("beginning"))
    longer = counts.select("gram", F.expr("left(gram, q - 1)").alias("beginning")).join(F.broadcast(often), "beginning")
    beginnings = [r[0] for r in often.collect()]
    grams = [r[0] for r in longer.select("gram").collect()]
    discard(counts)
    endings = {g[-q:] for g in grams for q in range(2, len(g))}
    by_size = lambda kept: {q: _numbers([g for g in kept if len(g) == q]) for q in range(2, longest)}
    return Grams(by_size(beginnings), by_size(endings))


def _numbers(grams: list[str]) -> np.ndarray:
    out = np.zeros(len(grams), dtype=np.uint64)
    for i, gram in enumerate(grams):
        out[i] = int.from_bytes(codes(gram.encode("latin-1")).tobytes(), "big")
    return np.sort(out)


# --- decomposition --------------------------------------------------------------------


def codes(latin: bytes) -> np.ndarray:
    """A byte under 128 for each character: letters beyond ASCII take the place of signs and capitals."""
    raw = np.frombuffer(latin, dtype=np.uint8)
    return np.where(raw >= 0xC0, raw - 0x9F, raw)


def _member(values: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    if known is None or not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def untouched(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int, longest: int, grams: Grams):
    """(word, kind, left, right) for each edit: what is left of and right of the grams that it can touch.

    Words lie from ``starts`` to ``ends`` in ``flat``, with a character before
    and after each that no edit takes. Kind 1 takes or replaces a character,
    kind 0 puts one between two. Rows that say the same are told once. Where no
    gram is untouched, left and right are the edit's own place.
    """
    n = len(flat)
    place = np.arange(n)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    begin, stop = starts[word], ends[word]
    frequent, endings = {}, {}
    number = np.zeros(n, dtype=np.uint64)
    for q in range(1, longest):
        inside = place + q <= stop
        number[inside] = (number[inside] << np.uint64(8)) | flat[place[inside] + q - 1]
        if q > 1:
            frequent[q] = inside & _member(number, grams.frequent.get(q))
            endings[q] = inside & _member(number, grams.endings.get(q))
    # the longest dictionary gram at each place, and those that are not inside one from further left
    size = np.full(n, shortest)
    for q in range(shortest, longest):
        size[(size == q) & frequent[q] & (place + q < stop)] = q + 1
    reach = np.where(place + shortest <= stop, place + size, 0)
    before = np.maximum.accumulate(np.concatenate([[0], reach[:-1]]))
    chosen = reach > np.maximum(before, begin)

    def at(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return values[np.clip(where, 0, n - 1)]

    # left of an edit at a place: grams that start from here on could grow over it
    grown = place - 1
    for q in range(2, longest):
        start = place - q
        grown[(start >= begin) & at(frequent[q], start)] = start[(start >= begin) & at(frequent[q], start)]
    left = begin.copy()
    for back in range(2 * longest, 0, -1):
        start = place - back
        fits = (start >= begin) & at(chosen, start) & (at(reach, start) <= place) & (start < grown)
        left[fits] = at(reach, start)[fits]
    # right of it: grams up to here could be swallowed by one that begins left of it
    swallowed = place + 1
    for q in range(2, longest):
        swallowed[endings[q]] = place[endings[q]] + q
    right = stop.copy()
    for ahead in range(2 * longest, -1, -1):
        start = place + ahead
        fits = (start < stop) & at(chosen, start) & (at(reach, start) > swallowed)
        right[fits] = start[fits]
    out = []
    for kind in (0, 1):
        edit = place[(place > begin) & (place + kind < stop)]
        a, b, w = left[edit], right[edit + kind], word[edit]
        none = (a == begin[edit]) & (b == stop[edit])
        a, b = np.where(none, edit, a), np.where(none, edit + kind, b)
        new = np.ones(len(edit), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out.append((w[new], np.full(new.sum(), kind), a[new], b[new], none[new]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


PRIMES = (2147483629, 2147483587)  # below 2 ** 31


@functools.cache
def _characters() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 31, (3, 128)).astype(np.uint64)


def _powers(base: int, count: int, prime: int | None) -> np.ndarray:
    """base ** 0, 1, ... below ``count``, by doubling; without a prime modulo 2 ** 64."""
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < count:
        more = out * np.uint64(step)
        out = np.concatenate([out, more if prime is None else more % np.uint64(prime)])
        step = step * step % (prime or 1 << 64)
    return out[:count]


def reach_hashes(flat, starts, ends, word, left, right):
    """Two numbers for what lies left of ``left`` and right of ``right`` in the words."""
    place = np.arange(len(flat))
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    ahead, behind = place - starts[owner], ends[owner] - 1 - place
    longest = int((ends - starts).max(initial=1))
    begin, stop = starts[word], ends[word]
    parts = []
    for row, (base, prime) in enumerate(((0x9E3779B97F4A7C15, None), (1_000_003, PRIMES[0]), (998_244_353, PRIMES[1]))):
        value = _characters()[row][flat]
        power = _powers(base, longest, prime)
        for weight, one, two in ((ahead, begin, left), (behind, right, stop)):
            terms = value % np.uint64(prime or 1 << 63) * power[weight]
            if prime:
                terms %= np.uint64(prime)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            difference = sums[two] - sums[one]
            parts.append(difference % np.uint64(prime) if prime else difference)
    mixed = parts[0] * np.uint64(0xBF58476D1CE4E5B9) ^ (parts[1] + (parts[1] << np.uint64(32)))
    mixed = mixed * np.uint64(0x94D049BB133111EB) + (left - begin).astype(np.uint64)
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + (stop - right).astype(np.uint64)
    first = (parts[2] << np.uint64(31)) ^ parts[3]
    second = (parts[4] << np.uint64(31)) ^ parts[5]
    return (mixed ^ first).view(np.int64), second.view(np.int64)


def edit_places(words: DataFrame, grams: Grams, shortest: int, longest: int) -> DataFrame:
    """(reach_a, reach_b, chars, kind, middle, id, n) of ``words`` (id, word, n): a row for each edit's grams.

    Words that come of one another by an edit have a row with the same ``reach``
    and ``chars`` (characters beside the edit), and differ in the ``middle``.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, ids, counts = batch.column("word").to_pylist(), batch.column("id").to_numpy(), batch.column("n").to_numpy()
        sizes = np.array([len(t) + 2 for t in texts])
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_CHARS)) + 1
        for part in np.split(np.arange(len(texts)), cuts):
            flat = codes("".join(f"{START}{texts[i]}{END}" for i in part).encode("latin-1"))
            ends = np.cumsum(sizes[part])
            starts = ends - sizes[part]
            word, kind, left, right, none = untouched(flat, starts, ends, shortest, longest, grams)
            a, b = reach_hashes(flat, starts, ends, word, left, right)
            for some in np.array_split(np.arange(len(word)), len(word) // (4 * CHUNK_CHARS) + 1):
                yield {
                    "reach_a": a[some] ^ none[some].astype(np.int64), "reach_b": b[some],
                    "chars": (sizes[part][word[some]] - 2 - kind[some]), "kind": kind[some],
                    "middle": _pieces(flat, left[some], right[some]), "id": ids[part][word[some]], "n": counts[part][word[some]],
                }

    ddl = "reach_a long, reach_b long, chars int, kind int, middle string, id long, n long"
    return map_batches(words.select("id", "word", "n"), run, ddl)


def _pieces(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    data = flat[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes()))


# --- near words and forms -------------------------------------------------------------


def near_pairs(words: DataFrame, shortest: int = SHORTEST_GRAM, longest: int = LONGEST_GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(a, b, a_n, b_n), once for each two of ``words`` (id, word, n) that are one edit apart.

    ``id`` tells words apart; words are distinct and of the letters a-z and
    those of ``LETTERS`` beyond ASCII. A list that many words are in is split by
    the join where it is too long for a task.
    """
    grams = gram_dictionary(words, shortest, longest, frequent)
    rows = store(edit_places(words, grams, shortest, longest), compression="zstd")
    reach = ["reach_a", "reach_b", "chars"]
    taken = rows.where("kind = 1").select(*reach, F.col("middle").alias("taken"), F.col("id").alias("a"), F.col("n").alias("a_n"))
    other = rows.select(*reach, "kind", "middle", F.col("id").alias("b"), F.col("n").alias("b_n"))
    found = taken.join(other, reach).where("kind = 0 or a < b").where(F.levenshtein("taken", "middle", 1) == 1)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ordered = found.select(
        low.alias("a"), high.alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"),
    )
    return ordered.distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, form): where the forms lead in the end; a null form ends.

    Each round doubles the steps taken; a form has more occurrences than what it
    is a form of, so there is an end.
    """
    now = store(forms.select("id", F.coalesce("form", "id").alias("root"), F.col("form").isNull().alias("done")))
    while not now.where("not done").isEmpty():
        ends = now.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("done").alias("at_end"))
        # only what is on its way is looked up
        moved = now.where("not done").join(ends, "root").select("id", F.col("next").alias("root"), F.col("at_end").alias("done"))
        former, now = now, store(now.where("done").union(moved))
        discard(former)
    return now.select("id", "root")


def variant_groups(
    docs: DataFrame, garble: int | None = 97, least_chars: int = 5, least_count: int = 3, factor: int = 2
) -> DataFrame:
    """Words of ``docs`` (doc_id, text), the more frequent word that each is a variant of, and where that leads.

    Words are those of ``words_of``. Two are near if one inserted, deleted or
    replaced code point makes one of the other. The form of a word is its near
    word of largest n, the first in code-point order among equals, if that n is
    at least ``factor`` (2 or more) times its own; else null. The root is found
    by following forms.

    Columns: word, form, root, n, n_near, form_n. Other columns of ``docs`` are
    left out. A null text has no words; no words give no rows. Rows that repeat
    count as often as they are there.
    """
    counted = store(words_of(docs, garble, least_chars, least_count))
    # numbers in code-point order, so that ids break ties
    words = store(global_index(counted, [F.asc("word")], "id"))
    pairs = near_pairs(words)
    ends = F.inline(F.array(
        F.struct(F.col("a").alias("id"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("id"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    ))
    best = F.max(F.when(F.col("near_n") >= factor * F.col("n"), F.struct("near_n", -F.col("near"))))
    found = pairs.select(ends).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = store(found.select("id", "n_near", (-F.col("best")["col2"]).alias("form"), F.col("best")["near_n"].alias("form_n")))
    roots = last_forms(words.select("id").join(near.select("id", "form"), "id", "left"))
    names = words.select("id", "word")
    out = words.join(near, "id", "left").join(roots, "id")
    out = out.join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form", "left")
    out = out.join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return out.select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"),
        F.col("n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )
