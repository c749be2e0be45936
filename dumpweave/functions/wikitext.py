"""Wikitext: markup, headings and sections, links.

Contract: comments, templates, tables and wiki links nested to any depth, external
links, tags, quote marks, common entities and headings. Single braces, as in
parameters, are text: inside a template they go with it. Marks that are never
closed, or close nothing, stay. Of a table its caption and cells are shown, cells
of a line a blank apart. Marks within pairs of verbatim tags are text, and so are
headings and links there; pairs of tags that show nothing (formulas, galleries)
go with what they hold. Parser functions are templates.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpweave.fixed_values import HEADING, INVISIBLE_TAGS, LEAD, VERBATIM_TAGS
from dumpweave.functions.translit import transliterate
from dumpweave.plans.barrier import bound, once

_SPACE = " \t\n\r\x0b\x0c "
# applied in turn; the amp entity comes last so that it makes no new entities
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def _change(text: Column, mark: str | Callable[[Column], Column], how: Callable[[Column], Column]) -> Column:
    """``how`` of texts that hold ``mark``, others as they are; ``text`` is worked out once."""
    holds = mark if callable(mark) else lambda t: t.contains(mark)
    return bound(text, lambda t: F.when(holds(t), how(t)).otherwise(t))


# marks that are text within verbatim tags, and characters of no text that stand for them meanwhile
_MARKS = "[]{}|=<>'!"
_HIDDEN = "".join(chr(0xFDD0 + i) for i in range(len(_MARKS)))
_TABLE, _TABLE_END = chr(0xFDE0), chr(0xFDE1)
_VERBATIM = rf"<({'|'.join(VERBATIM_TAGS)})\b[^<>/]*>"


def _hide_verbatim(text: Column) -> Column:
    """Comments removed, verbatim tags too, and the marks between these hidden."""

    def shown(piece: Column) -> Column:
        inner = F.regexp_replace(piece, r"(?s)\A<[^<>]*>|</[^<>]*>\z", "")
        return (
            F.when(piece.startswith("<!--"), "")
            .when((F.length(piece) > 1) & piece.startswith("<"), F.translate(inner, _MARKS, _HIDDEN))
            .otherwise(piece)
        )

    def hidden(whole: Column) -> Column:
        cut = rf"(?si)<!--.*?-->|{_VERBATIM}.*?</\1\s*>|[^<]++|<"
        return F.array_join(F.transform(F.regexp_extract_all(whole, F.lit(cut), F.lit(0)), shown), "")

    return _change(text, lambda t: t.contains("<") & t.rlike(rf"(?i)<!--|{_VERBATIM}"), hidden)


def _show_verbatim(text: Column) -> Column:
    return _change(text, lambda t: t.rlike(f"[{_HIDDEN[0]}-{_HIDDEN[-1]}]"), lambda t: F.translate(t, _HIDDEN, _MARKS))


def _pieces(text: Column, mark: str, close: str) -> Column:
    """The text cut at opening and closing marks, marks included.

    Of three closing characters in a row the last two are the mark.
    """
    closing = rf"{close}{close}(?!{close}(?!{close}))"
    marks = rf"{mark}{mark}|{closing}"
    return F.regexp_extract_all(text, F.lit(rf"{marks}|[^{mark}{close}]++|[{mark}{close}]"), F.lit(0))


def _fold_marks(
    text: Column, opening: str, closing: str, inner: Callable[[Column], Column],
    pieces: Callable[[Column], Column] | None = None,
) -> Column:
    """Replace all marked stretches, inner ones first, by ``inner`` of what they hold.

    The fold keeps a stack of the stretches that are open.
    """

    def step(stack: Column, piece: Column) -> Column:
        rest = F.slice(stack, F.lit(1), F.size(stack) - 1)
        top = F.element_at(stack, -1)
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        closed = F.concat(F.element_at(rest, -1), inner(top))
        return (
            F.when(piece == opening, F.concat(stack, F.array(F.lit(""))))
            .when((piece == closing) & (F.size(stack) > 1), F.concat(below, F.array(closed)))
            .otherwise(F.concat(rest, F.array(F.concat(top, piece))))
        )

    if pieces is None:
        pieces = lambda t: _pieces(t, re.escape(opening[0]), re.escape(closing[0]))

    def folded(whole: Column) -> Column:
        return F.array_join(F.aggregate(pieces(whole), F.array(F.lit("")), step), opening)

    return _change(text, opening, folded)


def _table_text(held: Column) -> Column:
    """Caption and cells of a table; ``held`` starts with its attributes."""

    def line(text: Column) -> Column:
        body = F.regexp_replace(text, r"^[ \t]*(?:\|\+|[|!])", "")
        parts = F.when(text.rlike(r"^[ \t]*!"), F.split(body, r"!!|\|\|")).otherwise(F.split(body, r"\|\|"))
        cells = F.transform(parts, lambda c: F.regexp_replace(c, r"^[^|\[\]{}]*\|", ""))
        row = text.rlike(r"^[ \t]*\|-")
        return F.when(row, "").when(text.rlike(r"^[ \t]*[|!]"), F.array_join(cells, " ")).otherwise(text)

    rows = bound(F.split(held, "\n"), lambda lines: F.slice(lines, F.lit(2), F.size(lines)))
    return F.array_join(F.transform(rows, line), "\n")


def _fold_tables(text: Column) -> Column:
    """Tables, marked at the starts of lines, as what they show."""

    def pieces(marked: Column) -> Column:
        return F.regexp_extract_all(marked, F.lit(f"[{_TABLE}{_TABLE_END}]|[^{_TABLE}{_TABLE_END}]++"), F.lit(0))

    def shown(whole: Column) -> Column:
        marked = F.regexp_replace(whole, r"(?m)^([ \t:]*)\{\|", f"$1{_TABLE}")
        marked = F.regexp_replace(marked, r"(?m)^([ \t]*)\|\}", f"$1{_TABLE_END}")
        out = _fold_marks(marked, _TABLE, _TABLE_END, _table_text, pieces)
        return F.replace(F.replace(out, F.lit(_TABLE), F.lit("{|")), F.lit(_TABLE_END), F.lit("|}"))

    return _change(text, lambda t: t.contains("{|") & t.rlike(r"(?m)^[ \t:]*\{\|"), shown)


def strip_markup(text: Column, headings: bool = True) -> Column:
    """The visible text. NULL gives ''. ``headings=False`` leaves heading lines alone."""
    return _show_verbatim(_visible(text, headings))


def _visible(text: Column, headings: bool) -> Column:
    """As ``strip_markup``, with the marks in verbatim text still hidden."""
    out = _hide_verbatim(F.coalesce(text, F.lit("")))
    invisible = rf"(?si)<({'|'.join(INVISIBLE_TAGS)})\b[^<>/]*>.*?</\1\s*>"
    out = _change(out, "</", lambda t: F.regexp_replace(t, invisible, ""))
    out = _fold_marks(out, "{{", "}}", lambda _: F.lit(""))
    out = _fold_tables(out)
    # a caption may hold links of its own
    out = _fold_marks(out, "[[", "]]", lambda held: F.regexp_replace(held, r"(?s)^[^|]*\|", ""))
    external = r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\]]*))?\]"
    out = _change(out, "://", lambda t: F.regexp_replace(t, external, "$1"))
    out = _change(out, "<", lambda t: F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", ""))
    out = _change(out, "''", lambda t: F.regexp_replace(t, r"'{2,}", ""))
    out = _change(out, "&", _show_entities)
    return _change(out, "=", lambda t: F.regexp_replace(t, HEADING, "$2")) if headings else out


def _show_entities(text: Column) -> Column:
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def extract_sections(
    df: DataFrame, text: str = "text", keep_headless: bool = True, markup: bool = True
) -> DataFrame:
    """Add ``headings`` and ``sections``, arrays of equal size.

    Headings of every level, flat, after a first one named Lead. Sections are
    transliterated, headings are not. Text without any heading is one Lead
    section; with ``keep_headless=False`` it gives empty arrays. NULL or empty
    text always gives empty arrays. ``markup=False`` skips markup removal, for
    text known to have none.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    body = _visible(raw, headings=False) if markup else raw
    # what was written verbatim shows its marks again once headings are found
    show = _show_verbatim if markup else lambda x: x
    staged = df.withColumn("_body", body)
    staged = staged.withColumn("_heads", F.regexp_extract_all("_body", F.lit(HEADING), F.lit(2)))
    trimmed = F.transform(F.split("_body", HEADING), strip_space)
    parts = F.transform(trimmed, lambda s: transliterate(show(s)))
    lead_only = F.lit(keep_headless) & (F.col("_body") != "")
    headed = F.size("_heads") > 0
    none = F.array().cast("array<string>")
    headings = (
        F.when(headed, F.concat(F.array(F.lit(LEAD)), F.transform("_heads", lambda h: strip_space(show(h)))))
        .when(lead_only, F.array(F.lit(LEAD)))
        .otherwise(none)
    )
    sections = F.when(headed | lead_only, parts).otherwise(none)
    return once(staged, headings=headings, sections=sections).drop("_body", "_heads")


def bracket_contents(text: Column) -> Column:
    """Contents of all ``[[...]]``, nested ones too, ordered by where they open."""
    entry = "struct<at:int,held:string>"
    none = F.array().cast(f"array<{entry}>")
    start = F.struct(F.lit(0).alias("n"), none.alias("open"), none.alias("found"))

    def one(at: Column, held: Column) -> Column:
        return F.array(F.struct(at.alias("at"), held.alias("held")))

    def step(state: Column, piece: Column) -> Column:
        stack, last = state["open"], F.element_at(state["open"], -1)
        rest = F.slice(stack, F.lit(1), F.size(stack) - 1)
        outer = F.element_at(rest, -1)
        whole = F.concat(F.lit("[["), last["held"], F.lit("]]"))
        closed = F.when(
            F.size(stack) > 1,
            F.concat(F.slice(rest, F.lit(1), F.size(rest) - 1), one(outer["at"], F.concat(outer["held"], whole))),
        ).otherwise(none)
        return (
            F.when(
                piece == "[[",
                F.struct(
                    (state["n"] + 1).alias("n"), F.concat(stack, one(state["n"], F.lit(""))).alias("open"),
                    state["found"].alias("found"),
                ),
            )
            .when(F.size(stack) == 0, state)
            .when(
                piece == "]]",
                F.struct(
                    state["n"].alias("n"), closed.alias("open"),
                    F.concat(state["found"], F.array(last)).alias("found"),
                ),
            )
            .otherwise(
                F.struct(
                    state["n"].alias("n"),
                    F.concat(rest, one(last["at"], F.concat(last["held"], piece))).alias("open"),
                    state["found"].alias("found"),
                )
            )
        )

    pieces = _pieces(F.coalesce(text, F.lit("")), r"\[", r"\]")
    found = F.aggregate(pieces, start, step)["found"]
    return F.transform(F.array_sort(found), lambda x: x["held"])


def extract_links(text: Column, use: str = "target") -> Column:
    """Links in document order, copies kept, transliterated.

    ``target`` gives the page linked to, without its section anchor, and drops
    files, images and categories; it stays in the JVM, as only links without
    links inside can be page links. ``display`` gives the text shown, nested
    links included, and drops thumbnails and categories by that text. What is
    in comments or within verbatim tags is no link.
    """
    text = _hide_verbatim(F.coalesce(text, F.lit("")))
    if use == "target":
        inner = F.regexp_extract_all(
            text, F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1)
        )
        shown = F.transform(
            inner,
            lambda x: strip_space(F.substring_index(F.substring_index(x, "|", 1), "#", 1)),
        )
        kept = F.filter(
            shown, lambda x: (x != "") & ~x.rlike(r"(?i)^:?\s*(file|image|category)\s*:")
        )
    elif use == "display":
        shown = F.transform(
            bracket_contents(text),
            lambda x: strip_markup(F.regexp_replace(x, r"(?s)^[^\[\]|]*\|", "")),
        )
        kept = F.filter(
            shown,
            lambda x: (strip_space(x) != "") & ~x.rlike(r"thumb\|.+") & ~x.rlike(r"Category:.+"),
        )
    else:
        raise ValueError(f"unknown use {use!r}")
    return F.transform(kept, lambda x: transliterate(x))
