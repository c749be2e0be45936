"""Operators on training data against plain versions, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dumpweave.llm import (
    decontaminate, imatch, interpolated_lm, jaccard_join, language_id, mixing,
    queries, substring_dedup, token_counts, token_files, warc_index,
)

SF = "/root/testdata/sf0.001"
BPE = queries.tokenizer_file("byte_bpe_50k.json")
RANKS = queries.tokenizer_file("byte_bpe_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def linked(rows, k, num, den):
    sets, root = [], {d: d for d, _ in rows if d is not None}
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if None not in (a, b) and both and den * both >= num * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(
        ((d, len(s), None if d is None else find(d) if s else d) for (d, _), s in zip(rows, sets, strict=True)),
        key=str,
    )


@pytest.mark.parametrize("how", [(4, 85, 100), (5, 4, 5)])
def test_jaccard(docs, odd, how):
    for table in (docs, odd):
        found = jaccard_join.jaccard_components(table, *how)
        assert sorted(map(tuple, found.collect()), key=str) == linked(pairs(table), *how)


def test_long_lists_meet_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 2)
    found = jaccard_join.jaccard_components(docs, 4, 85, 100)
    assert sorted(map(tuple, found.collect()), key=str) == linked(pairs(docs), 4, 85, 100)


def test_survivors(odd):
    left = jaccard_join.near_duplicate_survivors(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted(
        [1, 3, 4, 5, 6, None, None, 7, 9, 9], key=str
    )


def test_captures(spark):
    page = "x" * 1500
    rows = [(1, "http://a.org/x", page), (2, None, page), (2, "http://www.A.org/y?b=1#c", page), (None, "", page),
            (None, None, None), (3, "http://[bad", "short"), (4, "a\tb\\n", "short")]
    made = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    found = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_index.captures(made).collect()}
    assert found == {
        (1, 1500, "revisit", 2), (2, 1500, "response", None), (None, 1500, "revisit", 2),
        (None, 0, "response", None), (3, 5, "response", None), (4, 5, "response", None),
    }
    assert warc_index.captures(made.limit(0)).count() == 0


def test_index_finds_by_binary_search(monkeypatch):
    assert warc_index.capture_key("https://WWW.Site.org:80/p?q=1#f", 5).startswith("org,site)/p?q=1 ")
    reader = warc_index.BlockReader(["a", "m"], [warc_index._block(0, [("a", "f", 0, 1), ("c", "f", 1, 2)])["data"][0],
                                                 warc_index._block(1, [("m", "g", 3, 4)])["data"][0]])
    assert reader.find("c") == [("f", 1, 2)] and reader.find("m") == [("g", 3, 4)]
    assert reader.find("b") == [] and reader.find("0") == []


def encoded(text):
    from tokenizers import Tokenizer

    own = encoded.__dict__.setdefault("own", Tokenizer.from_file(BPE))
    return own.encode(text or "", add_special_tokens=False).ids


def test_counts_after_edits(docs, odd):
    edits = queries.document_edits()
    for table in (docs.limit(60), odd):
        rows = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("edits", edits).collect()
        want = []
        for r in rows:
            text = r.text
            for e in sorted(r.edits, key=lambda e: -e.start):
                text = text[: e.start] + e.inserted + text[e.start + e.removed :]
            want.append((r.doc_id, len(encoded(r.text)), len(encoded(text)), len(text)))
        found = token_counts.count_after_edits(table, BPE, edits).collect()
        assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(want, key=str)


def contaminated(rows, items, size=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    known = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            known[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc, text in rows:
        w, hit, names = words(text), set(), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit.update(range(i, i + k))
                    names |= known[tuple(w[i : i + k])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark, docs, odd):
    real = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    few = spark.createDataFrame([(1, "quick BROWN fox"), (2, None), (3, "--"), (1, "123"), (10, "fox")], real.schema)
    for table, items in ((docs, real), (odd, few)):
        want = contaminated(pairs(table), [tuple(r) for r in items.collect()])
        assert sorted(map(tuple, decontaminate.contamination_report(table, items).collect()), key=str) == want
    blocks = decontaminate.find_contamination(odd, few, block_bytes=5)
    whole = decontaminate.find_contamination(odd, few)
    columns = ["doc_id", "n_hit", "hit_items", "hit_spans"]
    assert sorted(map(str, blocks.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    clean = decontaminate.without_spans(odd, few)
    assert clean.count() == odd.count() and clean.where("text like '%fox%'").isEmpty()
    assert decontaminate.without_contaminated(odd, few).count() == 9
    assert decontaminate.without_contaminated(odd, few.limit(0)).count() == odd.count()


def test_token_files(docs, odd):
    for table in (docs, odd):
        found = [tuple(r) for r in token_files.token_files(table, BPE).collect()]
        ids = sorted(((d, [*encoded(t), 2]) for d, t in pairs(table)), key=lambda x: (x[0] is not None, x[0] or 0))
        want = Counter((d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in ids)
        assert Counter((d, n, c) for d, _, n, c in found) == want
        at = 0
        for doc, start, n, _ in sorted(found, key=lambda r: r[1]):
            assert start == at
            at += n
        assert [r[0] for r in sorted(found, key=lambda r: r[1])] == [d for d, _ in ids]
    assert token_files.token_files(odd.limit(0), BPE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 300, 5000])
def test_code(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(1.0, n) * 9).astype(np.int64) + 1
    lengths = token_files.code_lengths(counts, 13)
    assert lengths.max() <= 13 and (2.0 ** -lengths.astype(float)).sum() <= 1
    code = token_files.Code(lengths)
    ids = rng.integers(0, n, 1000).astype(np.uint32)
    block = token_files.pack_block(code, [3, None], np.array([400, 600]), ids, 9)
    doc_ids, sizes, back, before = token_files.unpack_block(code, block)
    assert doc_ids == [3, None] and sizes.tolist() == [400, 600] and before == 9 and (back == ids).all()


def test_mixture(spark, docs, odd):
    shares = np.array([0.6, 0.3, 0.1])
    exponent = mixing.bisected_exponent(shares, mixing.Target(repeats=2.0))
    assert math.isclose(exponent, 1 - math.log(2) / math.log(6), abs_tol=1e-9)
    assert mixing.bisected_exponent(shares, mixing.Target(entropy=9.0)) == 0
    for table in (docs, odd):
        words = mixing.word_count(F.col("text"))
        found = mixing.mixed(table, words, mixing.Target(repeats=2.0), block_tokens=50)
        assert sorted(map(str, found.select("doc_id", "text").distinct().collect())) == sorted(
            map(str, table.select("doc_id", "text").distinct().collect())
        )
        sums = table.groupBy("source").agg(F.sum(words).alias("n")).collect()
        got = {r.source: (r.n, r.w) for r in found.groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.first("mix_weight").alias("w")).collect()}
        assert {r.source for r in sums} == set(got)
    total = sum(n for n, _ in got.values())
    assert all(abs(n / total - w) < 0.4 for n, w in got.values())
    empty = mixing.mixed(odd.limit(0), words, mixing.Target(repeats=2.0))
    assert empty.count() == 0


def test_languages(docs, odd):
    found = language_id.held_out_predictions(docs, RANKS).join(docs, "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    odd_found = language_id.held_out_predictions(odd, RANKS).collect()
    assert len(odd_found) == odd.count()
    assert {r.doc_id for r in odd_found if r.lang_pred == "und"} >= {3, 4, 5, 6}
    assert all(0 <= r.score <= 1 for r in odd_found)
    none = language_id.held_out_predictions(odd.withColumn("lang", F.lit(None).cast("string")), RANKS)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_forward_sums_all_segmentations():
    from dumpweave.llm import kernels as K
    import pyarrow as pa

    vocabulary = language_id.Vocabulary(RANKS)
    rng = np.random.default_rng(0)
    p = np.zeros((len(vocabulary) + 1, 2))
    p[:-1] = rng.random((len(vocabulary), 2))
    place = {b: i for i, b in enumerate(vocabulary.pieces)}
    data, offsets = K.utf8(pa.array(["wörld", "a " + "x" * 50]))
    s = language_id.stretches(data, offsets, vocabulary)
    found = [language_id.log_probabilities(s, p)[s.of_word][s.text == i].sum(axis=0) for i in (0, 1)]

    def whole(word):
        total = np.zeros(2)
        for at in range(0, len(word), language_id.STRETCH_BYTES):
            part, alpha = word[at : at + language_id.STRETCH_BYTES], [np.ones(2)]
            for end in range(1, len(part) + 1):
                alpha.append(sum(alpha[i] * p[place[part[i:end]]] for i in range(max(0, end - 8), end) if part[i:end] in place))
            total += np.log(alpha[-1])
        return total

    assert np.allclose(found, [whole(" wörld".encode()), whole(b" a") + whole(b" " + b"x" * 50)])


def without_repeats(rows, length=200):
    count = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        count.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("runs", [20_000, 2])
def test_repeats(docs, odd, monkeypatch, runs):
    monkeypatch.setattr(substring_dedup, "SHARD_RUNS", runs)
    for table in (docs.limit(80), odd):
        found = substring_dedup.remove_repeats(table).drop("kept").collect()
        assert sorted(map(tuple, found), key=str) == without_repeats(pairs(table))


def test_fingerprints(docs, odd):
    for table in (docs, odd):
        found = imatch.edited_fingerprints(table).collect()
        rows = sorted(((d, t or "") for d, t in pairs(table)), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
        want = Counter()
        for i, (doc, text) in enumerate(rows):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + rows[(i + 1) % len(rows)][1][:cut]
            want[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
        assert Counter(tuple(r)[:3] for r in found) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    by_text = defaultdict(set)
    for r in imatch.edited_fingerprints(docs).collect():
        by_text[dict(pairs(docs))[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_scores(docs, odd, monkeypatch, head):
    monkeypatch.setattr(interpolated_lm, "HEAD", head)
    for table in (docs, odd):
        rows = pairs(table)

        def words(text):
            return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), "the end"]

        def out(doc):
            return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2

        count = Counter(w for d, t in rows if not out(d) for w in words(t))
        n, v = sum(count.values()), len(count)
        want = sorted(
            ((d, out(d), len(words(t)), sum(count[w] > 0 for w in words(t)), n,
              round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows), key=str,
        )
        found = interpolated_lm.held_out_scores(table).collect()
        assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in found), key=str) == want
        assert all(r.score < 0 for r in found)
    better = [r for r in interpolated_lm.held_out_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in better) > sum(r.base_score for r in better)


def plain_scores(rows, folds=7):
    """Scores of (doc_id, text) by word trigrams, bigrams and words, counted in dictionaries."""
    texts = [(d, ["^", "^", *re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "^"]) for d, t in rows]

    def grams(words):
        return [tuple(words[i - 2 : i + 1]) for i in range(2, len(words))]

    def fold(doc):
        return zlib.crc32(str(doc).encode()) % folds if doc is not None else 0

    def model(chosen):
        c, contexts = Counter(), Counter()
        for d, words in texts:
            for u, v, w in grams(words) if chosen(fold(d)) else []:
                c.update([(u, v, w), (v, w), (w,)])
                contexts.update([(u, v), (v,)])
        return c, contexts, sum(n for g, n in c.items() if len(g) == 1)

    v_size = len([g for g in model(lambda f: f != 2)[0] if len(g) == 1])

    def p(counted, u, v, w):
        c, contexts, n = counted
        base = (c[(w,)] + 1) / (n + v_size + 1)
        one = c[(w,)] / n
        two = c[(v, w)] / contexts[(v,)] if contexts[(v,)] else one
        return [c[(u, v, w)] / contexts[(u, v)] if contexts[(u, v)] else two, two, one, base]

    other, weights = model(lambda f: f not in (2, 3)), {}
    events = defaultdict(list)
    for d, words in texts:
        for g in grams(words) if fold(d) == 3 else []:
            events[other[1][g[:2]].bit_length()].append(p(other, *g))
    last = np.array([0, 0.3, 0.6, 0.1])
    for b in range(64):
        if b in events:
            found, last = np.array(events[b]), np.full(4, 0.25)
            for _ in range(30):
                shares = found * last
                last = (shares / shares.sum(axis=1, keepdims=True)).mean(axis=0)
        last = (last + 1e-6) / (last + 1e-6).sum()
        weights[b] = last
    full = model(lambda f: f != 2)
    return [(d, round(sum(math.log10(weights[full[1][g[:2]].bit_length()] @ p(full, *g)) for g in grams(words)), 5)) for d, words in texts]


def test_scores_are_of_word_ngrams(spark, docs):
    # words far beyond the most frequent ones, each seen twice, in pairs that always follow each other
    pairs_ = [f"left{i} right{i}" for i in range(1500)]
    rows = [(i, " ".join(pairs_[j % 1500] for j in range(i * 100, i * 100 + 100))) for i in range(30)]
    out = next(d for d in range(100, 200) if zlib.crc32(str(d).encode()) % 7 == 2)
    new = [out] + [d for d in range(out + 1, 300) if zlib.crc32(str(d).encode()) % 7 == 2][:1]
    rows += [(new[0], "left5 right5 left6 right6"), (new[1], "left5 right6 left6 right5")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in interpolated_lm.held_out_scores(table).collect()}
    assert abs(found[new[0]].base_score - found[new[1]].base_score) < 1e-9
    assert found[new[0]].score > found[new[1]].score + 1
    few = docs.limit(60)
    for some in (table, few):
        scores = interpolated_lm.held_out_scores(some).collect()
        want = sorted(plain_scores(pairs(some)))
        assert [d for d, _ in want] == sorted(r.doc_id for r in scores)
        assert np.allclose([s for _, s in want], [r.score for r in sorted(scores, key=lambda r: r.doc_id)], atol=1e-4)


def test_forward_has_no_limit_of_piece_or_word(monkeypatch):
    from dumpweave.llm import kernels as K
    import pyarrow as pa

    vocabulary = language_id.Vocabulary(RANKS)
    with open(RANKS, "rb") as lines:
        assert len(vocabulary) == sum(bool(x.strip()) for x in lines)
    rng = np.random.default_rng(1)
    p = np.zeros((len(vocabulary) + 1, 2))
    p[:-1] = rng.random((len(vocabulary), 2)) ** 40 + 1e-9
    place = {b: i for i, b in enumerate(vocabulary.pieces)}
    texts = ["internationally", "-" * 700, "今天天气很好我们一起去公园散步吧" * 20, "a " + "responsibilities" * 9, "x"]
    data, offsets = K.utf8(pa.array(texts))

    def plain(word):
        log = [np.zeros(2)]
        for end in range(1, len(word) + 1):
            own = [log[i] + np.log(p[place[word[i:end]]]) for i in range(max(0, end - vocabulary.longest), end) if word[i:end] in place]
            log.append(np.logaddexp.reduce(own))
        return log[-1]

    want = [sum(plain(b" " + w.encode()) for w in t.split()) for t in texts]
    for at_a_time in (language_id.STRETCH_BYTES, 7):
        monkeypatch.setattr(language_id, "STRETCH_BYTES", at_a_time)
        s = language_id.stretches(data, offsets, vocabulary)
        logs = language_id.log_probabilities(s, p)[s.of_word]
        assert np.allclose([logs[s.text == i].sum(axis=0) for i in range(len(texts))], want)
    # the bytes of the expected pieces are those of the words
    uses = language_id.expected_counts(s, p, np.ones((len(s.sizes), 2)))
    size = np.array([len(x) for x in vocabulary.pieces])
    assert np.allclose((uses[:-1] * size[:, None]).sum(axis=0), s.sizes.sum())
    assert uses[place[b" internationally"]].min() > 0


def test_mixture_weighs_tokens(spark, odd, tmp_path):
    import corpus_pipeline

    # a source of long unbroken strings has few words and many tokens
    unbroken = [(100 + i, "https://site.example/path?" + "q0Zx9" * (60 + i), "code") for i in range(20)]
    prose = [(200 + i, "a plain text of some common words " * 10, "prose") for i in range(20)]
    more = odd.select("doc_id", "text", "source")
    table = spark.createDataFrame(unbroken + prose, more.schema).unionByName(more)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()

    def weights(end):
        sums = Counter()
        for r in rows:
            sums[r.source] += len(encoded(r.text)) + end
        names = [x for x in sums if sums[x]]
        shares = np.array([sums[x] for x in names]) / sum(sums.values())
        return dict(zip(names, mixing.tempered(shares, mixing.bisected_exponent(shares, mixing.Target(repeats=2.0))), strict=True))

    found = queries.QUERIES["op6_mixing"](spark, str(tmp_path)).collect()
    sizes = {(r.doc_id, len(encoded(r.text))) for r in rows}
    assert {(r.doc_id, r.mix_tokens) for r in found} == sizes
    assert {r.source: round(r.mix_weight, 9) for r in found} == {x: round(w, 9) for x, w in weights(0).items()}
    # what is written holds the weights
    mixture = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert mixture.columns == docs.columns
    got = Counter()
    for r in mixture.collect():
        got[r.source] += len(encoded(r.text)) + 1
    want, total = weights(1), sum(got.values())
    assert all(abs(got[x] / total - want[x]) < 0.05 for x in want)
