"""Quality rules: learned decision lists over statistics of texts, in DataFrame operations only.

Rules are learned by sequential covering. A rule is grown on two thirds of the
labelled rows that no earlier rule covers, one threshold at a time, by the
information it gains about bad rows. It is then pruned on the other third: the
last thresholds go if that leaves it more precise there. A rule that is not precise enough on
the rows it was pruned on ends the list. The list becomes one ordered conditional
expression.

Every step of the search is one aggregation over the labelled rows, which hold a
small number for each statistic (between which of its cuts it lies). The driver
sees the sums: a count for each statistic, cut and label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.plans.barrier import once
from dumpweave.plans.session import discard, store

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS, CAPITALS, DIGITS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WINDOW = 3
#: Fewest words, and most words in hundred that may lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Candidate thresholds of a statistic, thresholds of a rule, rules of a list.
CUTS, MOST_TERMS, MOST_RULES = 32, 4, 12
#: Share of bad rows among what a rule covers of the rows it is pruned on.
LEAST_PRECISION = 0.95
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


# --- statistics -----------------------------------------------------------------------


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _number(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(_without(text, characters))).cast("long")


def _repeats(df: DataFrame, words: str) -> DataFrame:
    """``df`` (``words`` and others) with ``repeated``: words in windows that the text has twice or more.

    Windows are put in order with their places; equal neighbours tell the places
    that count. Each array is computed once per row.
    """
    own = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    more = [lambda i, k=k: F.get(F.col(words), i + k) for k in range(1, WINDOW)]
    # words hold no blanks
    windows = F.transform(own, lambda x, i: F.concat_ws(" ", x, *[get(i) for get in more]))
    df = once(df, _windows=windows)
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    df = once(df, _sorted=F.when(some, F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0))).drop("_windows")
    same = lambda x, at: F.coalesce(F.get(F.col("_sorted"), at)["w"] == x["w"], F.lit(False))
    found = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = once(df, _places=F.sort_array(F.transform(found, lambda x: x["i"]))).drop("_sorted")
    new = F.transform(
        "_places", lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(F.col("_places"), k - 1)))
    )
    return once(df, repeated=F.aggregate(new, F.lit(0).cast("long"), lambda a, b: a + b)).drop("_places")


def statistics(docs: DataFrame, row: bool = False) -> DataFrame:
    """``doc_id`` of each row of ``docs`` (doc_id, text), counts and shares of its text.

    A null text is an empty one. Shares of nothing are 0. With ``row`` the
    whole row is there as a struct.
    """
    carried = ["row"] if row else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = F.translate("text", BLANKS, " " * len(BLANKS))
    whole = [F.struct(*docs.columns).alias("row")] if row else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *whole)
    rows = once(
        rows,
        words=F.array_remove(F.split(blank, " "), ""),
        lines=F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, BLANKS)) > 0),
        word_chars=F.length(_without(F.col("text"), BLANKS)).cast("long"),
        n_symbols=_number(F.col("text"), SYMBOLS),
        n_capitals=_number(F.col("text"), CAPITALS),
        n_digits=_number(F.col("text"), DIGITS),
        n_cries=_number(F.col("text"), "!?"),
    ).drop("text")
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_different": F.size(F.array_distinct("words")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }).drop("lines")
    rows = _repeats(rows, "words").drop("words").withColumnRenamed("repeated", "n_repeat_words")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    shares = {
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "cry_share": share("n_cries", "word_chars"),
        "different_share": share("n_different", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }
    told = [F.col("n_words").cast("double").alias("length"), *[c.alias(n) for n, c in shares.items()]]
    return rows.select("doc_id", *COUNTS, *told, *carried)


#: What rules are about.
STATISTICS = (
    "length", "mean_word", "symbol_share", "capital_share", "digit_share", "cry_share",
    "different_share", "dup_line_share", "repeat_share", "words_per_line",
)


# --- rules ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A statistic at or above a cut, or below it."""

    statistic: str
    cut: float
    above: bool

    def column(self) -> Column:
        return F.col(self.statistic) >= self.cut if self.above else F.col(self.statistic) < self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; a text that meets it is bad."""

    terms: tuple[Term, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for term in self.terms:
            out = out & term.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))


def verdict(rules: list[Rule]) -> Column:
    """The text of the first rule that a row meets, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(str(rule))).otherwise(out)
    return out


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Bits gained about the bad rows that stay covered."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn_rules(
    rows: DataFrame, statistics: tuple[str, ...] = STATISTICS, cuts: int = CUTS, most_terms: int = MOST_TERMS,
    most_rules: int = MOST_RULES, least_precision: float = LEAST_PRECISION,
) -> list[Rule]:
    """A decision list from ``rows`` (doc_id, bad boolean, ``statistics``).

    All rows count. Thresholds are values of the statistics at ``cuts`` equal
    steps of their ranks among bad rows and among good ones (to a hundredth of a
    step). No bad rows, or no good ones, give no rules.
    """
    steps = [i / cuts for i in range(1, cuts)]
    quantiles = [
        F.percentile_approx(F.when(F.col("bad") == kind, F.col(s)), steps, 100 * cuts).alias(f"{s}_{kind}")
        for s in statistics for kind in (True, False)
    ]
    found = rows.agg(*quantiles).first()
    values = {s: sorted({*(found[f"{s}_True"] or ()), *(found[f"{s}_False"] or ())}) for s in statistics}
    # which cuts a row is at or above: as they are sorted, their number
    place = lambda s: F.size(F.filter(F.array(*map(F.lit, values[s])), lambda c: F.col(s) >= c)).alias(s)
    values = {s: v for s, v in values.items() if v}
    if not values:
        return []
    prune = F.pmod(F.xxhash64("doc_id", *statistics), F.lit(3)) == 0
    left = store(rows.select(prune.alias("prune"), "bad", *map(place, values)))
    whole = left

    def met(terms: list[tuple[str, int, bool]]) -> Column:
        out = F.lit(True)
        for s, i, above in terms:
            out = out & (F.col(s) > i if above else F.col(s) <= i)
        return out

    def best_term(terms: list) -> tuple[tuple[str, int, bool], int, int] | None:
        """The term that gains most on the growing rows that meet ``terms``, with what stays covered."""
        entries = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("at")) for s in values])).alias("e")
        counts = left.where(~F.col("prune") & met(terms)).select("bad", entries).groupBy("e.s", "e.at", "bad").count().collect()
        table = {s: [[0, 0] for _ in range(len(v) + 1)] for s, v in values.items()}
        for r in counts:
            table[r["s"]][r["at"]][0 if r["bad"] else 1] += r["count"]
        some = next(iter(table.values()))
        total = [sum(x[k] for x in some) for k in (0, 1)]
        best = None
        for s, bins in table.items():
            below = [0, 0]
            for i in range(len(bins) - 1):
                below = [below[0] + bins[i][0], below[1] + bins[i][1]]
                for above, (bad, good) in ((False, below), (True, [total[0] - below[0], total[1] - below[1]])):
                    gain = _gain(bad, good, *total) if total[0] else 0.0
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, (s, i, above), bad, good)
        return best[1:] if best else None

    rules: list[Rule] = []
    while len(rules) < most_rules:
        terms: list[tuple[str, int, bool]] = []
        while len(terms) < most_terms:
            grown = best_term(terms)
            if grown is None:
                break
            terms.append(grown[0])
            if not grown[2]:
                break
        if not terms:
            break
        test = left.where("prune")
        sums = []
        for size in range(1, len(terms) + 1):
            sums += [F.count(F.when(met(terms[:size]) & (F.col("bad") == kind), 1)).alias(f"{size}_{kind}") for kind in (True, False)]
        told = test.agg(*sums).first()
        worth = lambda size: (told[f"{size}_True"] - told[f"{size}_False"]) / max(told[f"{size}_True"] + told[f"{size}_False"], 1)
        size = max(range(1, len(terms) + 1), key=lambda k: (worth(k), -k))
        bad, good = told[f"{size}_True"], told[f"{size}_False"]
        if not bad or bad < least_precision * (bad + good):
            break
        terms = terms[:size]
        rules.append(Rule(tuple(Term(s, values[s][i], above) for s, i, above in terms)))
        left = left.where(~met(terms))
    discard(whole)
    return rules


# --- verdicts -------------------------------------------------------------------------


def base_failed() -> Column:
    """Too few words, or too many in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``stats`` that pass the base rules and ``labels`` (doc_id, quality) tells of; ``bad``: quality 0.

    Labels without doc_id or quality do not count; of several labels of a
    document the worst one does.
    """
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return stats.where(~base_failed()).join(told.agg((F.min("quality") <= 0).alias("bad")), "doc_id")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of each row of ``docs`` (doc_id, text), and whether it is kept.

    Base rules: fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED``
    in hundred words in repeated windows of three words, fail a text. Of the
    others, those that meet a rule learned from ``labels`` (doc_id, quality)
    are not kept; without labels all are.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and rule: what a text was rejected by,
    else null. Other columns are left out. A null text is an empty one. Rows
    that repeat are told each; no rows give no rows.
    """
    stats = store(statistics(docs))
    rules = learn_rules(labelled(stats, labels))
    rule = F.when(base_failed(), F.lit("base")).otherwise(verdict(rules))
    out = stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), rule.alias("rule"))
    return out.select("doc_id", *COUNTS, "base_failed", F.col("rule").isNull().alias("kept"), "rule")


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and others) that neither a base rule nor one of ``rules`` rejects, as they are."""
    kept = statistics(docs, row=True).where(~base_failed() & verdict(rules).isNull())
    return kept.select("row.*")
