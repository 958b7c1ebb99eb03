"""Text and tag columns as built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.presets import HELD, STOP_WORDS, TOKEN_LENGTH

# Blank characters stripped from both ends of a tag.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Runs of word characters other than decimal digits.
WORD_RUN = r"[\p{L}\p{Nl}\p{No}_]+"
# The same runs; the plain letters, which \p{L} holds too, are tried first.
LETTERS_FIRST = WORD_RUN.replace("[", "[a-z", 1)


@cache
def _accent_tables() -> tuple[str, str]:
    """Characters to replace and their plain forms; marks come last and vanish.

    Covers every code point that is a mark or loses marks by decomposition.
    """
    accented, plain, marks = [], [], []
    for char in map(chr, range(0xC0, 0x110000)):
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        if not unicodedata.decomposition(char) or unicodedata.decomposition(char)[0] == "<":
            continue
        kept = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        base = unicodedata.normalize("NFC", "".join(kept))
        if base != char and len(base) == 1:
            accented.append(char)
            plain.append(base)
    return "".join(accented + marks), "".join(plain)


def strip_accents(col: Column) -> Column:
    """Plain letters for accented ones; texts of one byte per character pass through."""
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, col).otherwise(F.translate(col, *_accent_tables()))


def concat_columns(cols: Sequence[Column]) -> Column:
    """Join columns with a blank; a missing value reads ``nan`` unless it stands alone."""
    if len(cols) == 1:
        return cols[0].cast("string")
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in cols])


def clean(col: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Apply regular-expression replacements in order.

    A text without what every match holds is passed on without a search. The array of
    one element names the text, so that it is computed once for test and value.
    """
    for pattern, text in replacements:
        def replaced(c: Column) -> Column:
            return F.regexp_replace(c, F.lit(pattern), F.lit(text))

        held = HELD.get(pattern)
        if held is None:
            col = replaced(col)
        else:
            col = F.transform(
                F.array(col), lambda c: F.when(F.contains(c, F.lit(held)), replaced(c)).otherwise(c)
            )[0]
    return col


def tokens(col: Column) -> Column:
    """Lower-cased, accent-free word runs of 1 to 60 characters not starting with '_'."""
    runs = F.regexp_extract_all(strip_accents(F.lower(col)), F.lit(LETTERS_FIRST), F.lit(0))
    low, high = TOKEN_LENGTH
    return F.filter(
        runs, lambda t: F.length(t).between(low, high) & ~F.startswith(t, F.lit("_"))
    )


def drop_stop_words(col: Column, stop: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    return F.filter(col, lambda t: ~t.isin(*stop))


def or_empty_token(col: Column) -> Column:
    """A post without tokens, or without text, holds the one empty token."""
    none = F.coalesce(F.size(col), F.lit(0)) <= 0
    return F.when(none, F.array(F.lit(""))).otherwise(col)


def parse_list(col: Column) -> Column:
    """Comma list to trimmed array; NULL gives the one empty entry."""
    return F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x, F.lit(BLANKS)))


def tag_set(col: Column) -> Column:
    """Sorted distinct lower-cased tags of a comma list; NULL gives ``['']``."""
    return F.sort_array(F.array_distinct(F.transform(parse_list(col), lambda t: F.lower(t))))


def tag_count(col: Column) -> Column:
    """Entries of a comma list, repeats and blanks included; NULL counts as one."""
    return F.when(col.isNull(), F.lit(1)).otherwise(F.size(F.split(col, ",")))


def tag_statistics(col: Column) -> tuple[Column, Column]:
    """(number of tags, mean trimmed tag length) of a comma list; (0, 0) for NULL."""
    entries = F.split(col, ",")
    total = F.aggregate(
        entries, F.lit(0), lambda acc, t: acc + F.length(F.trim(t, F.lit(BLANKS)))
    )
    count = F.when(col.isNull(), F.lit(0)).otherwise(F.size(entries))
    mean = F.when(col.isNull(), F.lit(0.0)).otherwise(total / F.size(entries))
    return count.cast("double"), mean.cast("double")


def has_phrase(col: Column, phrases: Sequence[str]) -> Column:
    """1 if a phrase stands between blanks in the lower-cased text, else 0.

    Phrases are compared as given, so one with capitals never matches. Phrases
    without a blank are looked up among the blank-separated pieces in one pass.
    """
    padded = F.concat(F.lit(" "), F.lower(col), F.lit(" "))
    single = [p for p in phrases if " " not in p]
    hit = F.lit(False)
    if len(single) > 8:
        hit = F.arrays_overlap(F.split(F.lower(col), " "), F.array(*[F.lit(p) for p in single]))
        phrases = [p for p in phrases if " " in p]
    for phrase in phrases:
        hit = hit | F.contains(padded, F.lit(f" {phrase} "))
    return hit.cast("int")


def latin_words(col: Column) -> Column:
    """Runs of a-z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), F.lit(0))
