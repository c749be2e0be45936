"""Quality rules, conversation trie and spelling variants against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from dumpweave.llm import conversation_trie, quality_rules, queries, spelling_variants

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_spelling_variants"])
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


# --- quality rules --------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    number = Counter(windows)
    twice = {i + k for i, w in enumerate(windows) if number[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice),
        n < 50 or 100 * len(twice) > 50 * n,
    )


def test_counts(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lines = "a b c a b c\n\na b c\n \na b c\n a b c \x0b  x\n" * 3
    more = spark.createDataFrame([(1, lines), (2, lines * 2000), (3, "# ** <é> 😀 " * 60), (4, "a b"), (5, "a b c a b c a b")], "doc_id long, text string")
    for table in (docs, odd, more):
        found = quality_rules.quality_verdicts(table, labels).collect()
        want = Counter((d, *counts(t)) for d, t in pairs(table))
        assert Counter(tuple(r)[:7] for r in found) == want
        assert all(not r.kept or not r.base_failed for r in found)
        assert all(r.kept == (r.rule is None) and (r.rule == "base") == r.base_failed for r in found)
    empty = quality_rules.quality_verdicts(odd.limit(0), labels)
    assert empty.count() == 0 and empty.columns[:8] == ["doc_id", *quality_rules.COUNTS, "base_failed", "kept"]
    for none in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert quality_rules.quality_verdicts(docs, none).where("kept = base_failed").isEmpty()


def plain_rules(rows, statistics, cuts_of, most_terms=4, most_rules=12, least=0.95):
    """Sequential covering over (prune, bad, {statistic: value}) in plain loops."""

    def meets(row, terms):
        return all((row[2][s] >= cut) == above for s, cut, above in terms)

    def tally(chosen, terms):
        inside = [r for r in chosen if meets(r, terms)]
        bad = sum(r[1] for r in inside)
        return bad, len(inside) - bad

    left, out = list(rows), []
    while len(out) < most_rules:
        grow, terms = [r for r in left if not r[0]], []
        while len(terms) < most_terms:
            before, best = tally(grow, terms), None
            for s in statistics:
                for cut in cuts_of[s]:
                    for above in (False, True):
                        after = tally(grow, [*terms, (s, cut, above)])
                        gain = quality_rules._gain(*after, *before) if before[0] else 0
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, (s, cut, above), after)
            if best is None:
                break
            terms.append(best[1])
            if not best[2][1]:
                break
        if not terms:
            break
        tallies = [tally([r for r in left if r[0]], terms[:k]) for k in range(1, len(terms) + 1)]
        size = max(range(len(terms)), key=lambda k: ((tallies[k][0] - tallies[k][1]) / max(sum(tallies[k]), 1), -k))
        bad, good = tallies[size]
        if not bad or bad < least * (bad + good):
            break
        out.append(terms[: size + 1])
        left = [r for r in left if not meets(r, out[-1])]
    return out


def test_rules_equal_plain_covering(spark):
    rng = np.random.default_rng(3)
    made = []
    for i in range(400):
        a, b = rng.integers(0, 12, 2)
        made.append((i, bool((a > 8 and b < 6) or (b > 10 and a < 3)), float(a), float(b)))
    rows = spark.createDataFrame(made, "doc_id long, bad boolean, a double, b double").repartition(5)
    prune = F.pmod(F.xxhash64("doc_id", "a", "b"), F.lit(3)) == 0
    told = [(r.prune, r.bad, {"a": r.a, "b": r.b}) for r in rows.withColumn("prune", prune).collect()]
    cuts = {s: sorted({r[2][s] for r in told}) for s in "ab"}
    found = quality_rules.learn_rules(rows, ("a", "b"), cuts=400)
    # the smallest value is no candidate of either side of the quantiles' ends: it tells nothing apart
    want = plain_rules(told, ("a", "b"), cuts)
    assert [[(t.statistic, t.cut, t.above) for t in r.terms] for r in found] == want
    assert len(found) >= 2 and any(len(r.terms) > 1 for r in found)
    rejected = rows.where(quality_rules.verdict(found).isNotNull())
    assert rejected.where("bad").count() > 0.9 * rows.where("bad").count()
    assert rejected.where("not bad").count() < 0.02 * rows.where("not bad").count()


def test_rules_reject_bad_and_keep_good(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = labels.where("crc32(cast(doc_id as string)) % 4 = 2")  # never seen
    found = quality_rules.quality_verdicts(docs, labels.join(out, "doc_id", "left_anti")).join(out, "doc_id").where("not base_failed")
    bad, good = found.where("quality = 0"), found.where("quality = 1")
    assert bad.where("kept").count() <= 0.1 * bad.count() and good.where("not kept").count() <= 0.02 * good.count()


def test_kept_documents_are_as_they_were(odd):
    clash = {c: F.lit(5) for c in ("words", "lines", "row", "n_words", "repeated", "_sorted", "length", "rule", "bad")}
    table = odd.withColumns(clash)
    rule = quality_rules.Rule((quality_rules.Term("length", 5000.0, True),))
    kept = quality_rules.kept_documents(table, [rule])
    assert kept.schema == table.schema
    want = [r for r in table.collect() if not counts(r.text)[5] and counts(r.text)[0] < 5000]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want)) and want == []
    kept = quality_rules.kept_documents(table.withColumn("text", F.expr("concat(text, ' ', array_join(sequence(1, 400), ' '))")), [rule])
    assert kept.count() == 11 - 2


# --- conversation trie ----------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, said), role, text))
    own = {c: [x[1:] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(whole[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), up, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks(spark):
    rng = np.random.default_rng(5)
    said = ["hello there", "", None, "how are you\ttoday", "fine", "a longer answer of some words"]
    rows = [(int(c), int(t), ["user", "bot", None][t % 3], said[rng.integers(0, 6)]) for c in range(-30, 60) for t in range(rng.integers(1, 6))]
    rows += [(3, None, "user", "first of all"), (3, 1, "user", "same turn"), (3, 1, "bot", "same turn"), (None, 1, "user", "lost"), (7, None, None, None)]
    rows += [(70, 2, "user", "again")] * 9 + [(101, 1, "user", "one turn only"), (5000, 0, "u", "long 0")]
    rows += [(5001, t, "u", f"turn {t % 7}") for t in range(300)] + [(5021, t, "u", f"turn {t % 7}") for t in range(250)]
    made = spark.createDataFrame(rows, TURNS).repartition(6)
    return made.withColumns({c: F.lit(1) for c in ("depth", "id_a", "place", "said", "words", "n", "range", "leaves", "route")})


def test_trie(spark, talks):
    found = conversation_trie.trie(talks)
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=str) == plain_trie(rows)
    assert conversation_trie.trie(talks.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, 1, "user", "said")], TURNS)
    assert sorted(map(tuple, conversation_trie.trie(alone).collect()), key=str) == plain_trie([(1, 1, "user", "said")])


@pytest.mark.parametrize("limits", [(40, 3), (7, 200_000), (5_000, 1)])
def test_trie_in_rounds_with_spills(talks, monkeypatch, limits):
    monkeypatch.setattr(conversation_trie, "SHARD_NODES", limits[0])
    monkeypatch.setattr(conversation_trie, "QUEUE_MESSAGES", limits[1])
    monkeypatch.setattr(conversation_trie, "PIECE_CHARS", 9)
    monkeypatch.setattr(conversation_trie, "COPIES", 2)
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, conversation_trie.trie(talks).collect()), key=str) == plain_trie(rows)


def test_queue_spills_and_sums(tmp_path):
    rng = np.random.default_rng(1)
    messages = [(int(a), 0, int(b), 1, int(c), 1) for a, b, c in rng.integers(0, 20, (5000, 3))]
    queue = conversation_trie.SpillingQueue(str(tmp_path), 100)
    want = defaultdict(lambda: [0, 0, 0])
    for m in messages:
        queue.put(m)
        for i in range(3):
            want[m[:3]][i] += m[3 + i]
    assert len(list(tmp_path.iterdir())) > 10
    got = []
    while queue.first() is not None:
        got.append(queue.take())
    assert got == sorted((k, v) for k, v in want.items())
    queue.close()
    assert not list(tmp_path.iterdir())


# --- spelling variants ----------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, garble=97, least_chars=5, least_count=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if garble and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}
    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(((-n[x], x) for x in beside[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= 2 * c else None
    out = []
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants(spark, odd):
    long = "x" * 3000
    letters = ["ÀÉÎõü", "ÀÉÎõü", "ÀÉÎõü", "àéîõü", "ÿÿÿÿÿ", "ÿÿÿÿÿ", "ÿÿÿÿÿÿ", "×÷×÷×", "MiXeDÉ", "mixedÉ", "mixedé", "don't-stop"]
    rows = [(i, " ".join(letters * 3 + [long, long + "y", long[:-1], "aaaaa", "aaaaaa", "aaaaaaa"])) for i in range(4)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (odd, more):
        for garble in (97, 2, None):
            found = spelling_variants.variant_groups(table, garble)
            assert sorted(map(tuple, found.collect()), key=str) == plain_variants(pairs(table), garble)
    assert spelling_variants.variant_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("grams", [(2, 2, 512), (2, 3, 40), (2, 4, 64), (2, 5, 2000), (3, 6, 300), (2, 8, 5000)])
def test_near_pairs_for_any_dictionary(spark, grams):
    rng = np.random.default_rng(11)
    parts = ["th", "on", "re", "ing", "é", "a", "ß", "schen"]
    words = sorted({"".join(parts[i] for i in rng.integers(0, 8, rng.integers(2, 6))) for _ in range(700)} | {"a", "aa", "b", "th"})
    table = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "id long, word string, n long").repartition(3)
    found = spelling_variants.near_pairs(table, *grams).collect()
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b)}
    assert len(found) == len({tuple(r)[:2] for r in found}) and {tuple(r)[:2] for r in found} == want


# --- fingerprints by I-Match ------------------------------------------------------------


def test_imatch_equals_plain_fingerprints(spark, docs, odd):
    from pyspark.sql.types import LongType, StringType

    from dumpweave.llm import imatch

    def hashes(values, kind):
        """xxhash64 of single values, by the engine."""
        made = spark.createDataFrame([(v,) for v in values], f"v {kind().simpleString()}")
        return {r.v: r.h for r in made.select("v", F.xxhash64("v").alias("h")).collect()}

    for table in (docs, odd):
        rows = [(d, t or "") for d, t in pairs(table)]
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
        # Java lower-cases as Python does for the letters here
        words = lambda t: set(re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) - {""}
        df = Counter(w for _, t in rows for w in words(t))
        band = [w for w, n in df.items() if imatch.IDF_LEAST <= np.log2(len(rows) / n) <= imatch.IDF_MOST]
        ids = hashes(band, StringType)
        known = spark.createDataFrame([(i,) for i in ids.values()], "id long") if ids else None
        subsets = {}
        if known is not None:
            marks = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << d)) == 0).alias(f"s{i}") for i, d in enumerate(imatch.DENSITIES)]
            subsets = {r.id: [r[f"s{i}"] for i in range(len(marks))] for r in known.select("id", *marks).collect()}

        def parts(text):
            own = sorted(ids[w] for w in words(text) if w in ids and any(subsets[ids[w]]))
            return [[i for i in own if subsets[i][k]] for k in range(len(imatch.DENSITIES))] if own else text

        def likeness(a, b):
            if isinstance(a, str) or isinstance(b, str):
                # a text without terms is known by itself
                told = [k for k in range(24) if not (isinstance(a, list) and not a[k] and isinstance(b, list) and not b[k])]
                return float(isinstance(a, str) and isinstance(b, str) and a == b) if told else 0.0
            told = [k for k in range(24) if a[k] or b[k]]
            return sum(a[k] == b[k] for k in told) / max(len(told), 1)

        want = Counter()
        for i, (doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            want[(doc, len(text), round(likeness(parts(text), parts(edited)), 9), round(likeness(parts(text), parts(after)), 9))] += 1
        found = imatch.edited_fingerprints(table).collect()
        assert Counter((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
        # equal parts, equal fingerprints, and the other way round
        named = {}
        for r in found:
            named.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
        held = defaultdict(set)
        for doc, text in rows:
            if len(named[doc, len(text)]) == 1:
                held[str(parts(text))].add(next(iter(named[doc, len(text)])))
        assert all(len(x) == 1 for x in held.values()) and len({next(iter(x)) for x in held.values()}) == len(held)


# --- pipeline stages and columns of their rows ------------------------------------------


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontamination", "mixture"])
def test_stages_leave_columns_as_they_were(spark, odd, name):
    import corpus_pipeline

    clash = (
        "score", "lang_pred", "_lang", "n_words", "hit_items", "hit_spans", "n_hit", "_items", "_spans", "tokens", "epochs", "blocks",
        "_whole", "_draw", "_tokens", "n_tokens", "mix_tokens", "mix_epoch", "mix_place", "_source", "_dropped_id", "component_id", "a b",
    )
    table = odd.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.substring("text", 1, 5), F.lit("none"))) for c in clash})
    found = dict(corpus_pipeline.STAGES)[name](spark, table, SF)
    assert found.schema.names == table.schema.names
    rows, before = found.collect(), {str(r) for r in table.collect()}
    assert rows and {str(r) for r in rows} <= before
    empty = dict(corpus_pipeline.STAGES)[name](spark, table.limit(0), SF)
    assert empty.count() == 0 and empty.columns == table.columns


def test_null_edits_among_others(spark):
    from dumpweave.llm import token_counts

    edits = F.expr(
        "array(named_struct('start', 5, 'removed', 1, 'inserted', 'x'), null, "
        "named_struct('start', cast(null as int), 'removed', cast(null as int), 'inserted', 'start '), "
        "named_struct('start', 8, 'removed', 2, 'inserted', cast(null as string)))"
    )
    rows = spark.createDataFrame([(1, "some text to edit"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: tuple(r) for r in token_counts.count_after_edits(rows, queries.tokenizer_file("byte_bpe_50k.json"), edits).collect()}
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    size = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    assert found[1][1:4] == (size("some text to edit"), size("start some xexto edit"), len("start some xexto edit"))
    assert found[2][1] == 0
