"""Suffix stripping (Porter 1980 with the usual extensions) over token arrays."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix replaced when the stem before it has measure above 0.
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
FURTHER = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
# Suffix dropped when the stem before it has measure above 1.
DROPPED = set(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


class _Letters(dict):
    """Letter to 'c' or 'v' for ``str.translate``, filled as letters turn up."""

    def __missing__(self, point: int) -> str:
        self[point] = "v" if chr(point) in "aeiou" else "c"
        return self[point]


_LETTERS = _Letters()


def _shape(word: str) -> str:
    """'c' and 'v' per letter; y is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(_LETTERS)
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """Number of vowel runs followed by a consonant."""
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    for size in range(min(7, len(word)), 1, -1):
        if word[-size:] in suffixes:
            return word[-size:]
    return None


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = _longest(word, ("ed", "ing"))
    if cut is None or "v" not in _shape(word[: -len(cut)]):
        return word
    stem = word[: -len(cut)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_end(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    cut = _longest(word, DERIVED)
    if cut is None:
        return word
    stem = word[: -len(cut)]
    judged = word[:-3] if cut == "logi" else stem
    return stem + DERIVED[cut] if _measure(judged) > 0 else word


def _further(word: str) -> str:
    cut = _longest(word, FURTHER)
    if cut is None or _measure(word[: -len(cut)]) == 0:
        return word
    return word[: -len(cut)] + FURTHER[cut]


def _dropped(word: str) -> str:
    cut = _longest(word, DROPPED)
    if cut is None:
        return word
    stem = word[: -len(cut)]
    if _measure(stem) < 2 or (cut == "ion" and stem[-1] not in "st"):
        return word
    return stem


def _final(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        size = _measure(stem)
        if size > 1 or (size == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if len(word) > 2 and word[-1] == "y" and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    return _final(_dropped(_further(_derived(word))))


def _stem_lists(lists: pa.Array) -> pa.Array:
    """Stem the distinct tokens of a batch once and spread them back."""
    words = lists.flatten().dictionary_encode()
    known = pa.array([stem_word(w) for w in words.dictionary.to_pylist()], pa.string())
    flat = known.take(words.indices)
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(sizes.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def stems(col: Column) -> Column:
    """Stem every token of an array, order and repeats kept; no shuffle."""
    return F.arrow_udf(_stem_lists, T.ArrayType(T.StringType()))(col)
