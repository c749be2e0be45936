"""Unicode to ASCII inside the JVM: one ``translate`` plus a few replaces."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from dumpweave.fixed_values import ASCII_FORMS, SCRIPT_FORMS
from dumpweave.plans.barrier import bound

# Latin letters with marks, typographic marks, ligatures, full-width forms
_BLOCKS = [(0x00A0, 0x024F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]
# Greek, Cyrillic, Greek with several marks
_SCRIPTS = [(0x0370, 0x03FF), (0x0400, 0x052F), (0x1F00, 0x1FFF)]
# what goes from a text: Latin letters and marks without a form, and what is no letter, number or mark of a script
_DROPPED = r"[\x{80}-\x{24F}\x{2B0}-\x{36F}\x{1E00}-\x{1EFF}\x{FE00}-\x{FE0F}]|[^\x00-\x7F\p{L}\p{M}\p{N}]"


def _decomposed(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()


def _script_form(char: str) -> str:
    """ASCII form of a Greek or Cyrillic letter, or '' if it has none."""
    if char in SCRIPT_FORMS:
        return SCRIPT_FORMS[char]
    bases = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
    return "".join(SCRIPT_FORMS[c] for c in bases) if bases and all(c in SCRIPT_FORMS for c in bases) else ""


@cache
def ascii_tables(mode: str = "letters") -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): one-to-one characters, and those with longer forms."""
    fixed = ASCII_FORMS if mode == "letters" else {}
    source, target, longer = [], [], []
    for first, last in _BLOCKS:
        for code in range(first, last + 1):
            char = chr(code)
            form = fixed.get(char, _decomposed(char))
            if len(form) == 1:
                source.append(char)
                target.append(form)
            elif form.strip() and (char in fixed or char.isalpha()):
                longer.append((char, form))
    for first, last in _SCRIPTS if mode == "letters" else []:
        for char in map(chr, range(first, last + 1)):
            form = _script_form(char)
            if len(form) == 1:
                source.append(char)
                target.append(form)
            elif form:
                longer.append((char, form))
    return "".join(source), "".join(target), tuple(longer)


def transliterate(text: Column, mode: str = "letters", keep: bool = True) -> Column:
    """ASCII form of Latin, Greek and Cyrillic text.

    ``letters`` also spells out letters and marks that Unicode does not
    decompose (``ß`` to ``ss``, ``Ж`` to ``Zh``). Letters, numbers and marks of
    other scripts stay as they are, so that no text is lost, unless ``keep`` is
    false; ``transliteration_status`` tells such texts. Combining marks of Latin and symbols without a form are
    dropped. ``nfkd`` only decomposes and drops all else. Text that is ASCII
    already is passed on after one test.
    """
    if mode not in ("letters", "nfkd"):
        raise ValueError(f"unknown mode {mode!r}")
    source, target, longer = ascii_tables(mode)
    dropped = _DROPPED if mode == "letters" and keep else r"[^\x00-\x7F]+"

    def spelled(whole: Column) -> Column:
        out = _spell_longer(F.translate(whole, source, target), longer)
        return bound(out, lambda t: F.when(t.rlike(_OTHER), F.regexp_replace(t, dropped, "")).otherwise(t))

    return bound(text, lambda t: F.when(t.rlike(_OTHER), spelled(t)).otherwise(t))


_OTHER = r"[^\x00-\x7F]"


def _ranges(chars: str, gap: int = 0x200) -> str:
    """A few ranges that hold ``chars``, as they stand in a class; a class of single characters is slow."""
    codes = sorted(map(ord, chars))
    starts = [codes[0], *(b for a, b in zip(codes, codes[1:], strict=False) if b - a > gap)]
    ends = [*(a for a, b in zip(codes, codes[1:], strict=False) if b - a > gap), codes[-1]]
    return "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in zip(starts, ends, strict=True))


def _spell_longer(text: Column, longer: tuple[tuple[str, str], ...]) -> Column:
    """Characters with forms of other lengths, as these: the text is cut once, however many there are."""
    near = _ranges("".join(char for char, _ in longer))
    forms = F.create_map(*[F.lit(x) for pair in longer for x in pair])

    def form(piece: Column) -> Column:
        return F.when(F.char_length(piece) == 1, F.coalesce(F.element_at(forms, piece), piece)).otherwise(piece)

    def all_spelled(whole: Column) -> Column:
        pieces = F.regexp_extract_all(whole, F.lit(f"[{near}]|[^{near}]++"), F.lit(0))
        return F.array_join(F.transform(pieces, form), "")

    return bound(text, lambda t: F.when(t.rlike(f"[{near}]"), all_spelled(t)).otherwise(t))


def transliteration_status(text: Column) -> Column:
    """``ascii`` as it is, ``spelled`` out whole, or ``partly`` if letters of other scripts stay; null for null."""
    kept = transliterate(text).rlike(r"[^\x00-\x7F]")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), "ascii").when(kept, "partly").when(~kept, "spelled")
