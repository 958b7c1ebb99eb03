"""Secrets in texts: fixed patterns, and windows of high Shannon entropy.

Candidate strings are scanned by windows of a width per character class. The
entropy of a window comes from counts that change by one character in and one
out; a candidate with a window at or above the class's threshold is a span from
end to end, unless that window reads as names: most neighbouring letters are pairs
usual in words. Strings on the allow list give no such span. Spans of the patterns
stay in any case.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import prepare

# The patterns of known secrets, in the order in which kinds sort.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Strings that may hold a secret without saying so.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: its members, window width and least entropy."""

    name: str
    member: re.Pattern
    width: int
    bits: float


# The first class that has all characters of the candidate applies; a candidate
# shorter than the width is one window. Of random strings of 20 characters of a
# class's alphabet at most a few in ten thousand stay below its threshold.
CLASSES = (
    CharClass("hex", re.compile(r"[0-9A-Fa-f]+"), 20, 2.6),
    CharClass("base32", re.compile(r"[A-Z2-7]+=*|[a-z2-7]+=*"), 20, 3.0),
    CharClass("single", re.compile(r"[A-Z0-9]+|[a-z0-9]+"), 20, 3.0),
    CharClass("alnum", re.compile(r"[A-Za-z0-9]+"), 20, 3.3),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 3.3),
)
# Candidates that are no secrets: words of letters with joins, words and short numbers
# with joins, numbers, UUIDs, rules. Quantifiers give nothing back, so a long string
# costs one pass.
ALLOWED = (
    re.compile(r"[a-z]++(?:[-_/=+][a-z]++)*+|[A-Z]++(?:[-_/=+][A-Z]++)*+"),
    re.compile(r"(?:(?:[A-Z]++(?![a-z])|[A-Z]?[a-z]++|[0-9]{1,4}+)(?:[-_/=+]++|\Z))++"),
    re.compile(r"[0-9]++(?:[-_/=+][0-9]++)*+(?:e[-+]?[0-9]++)?"),
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"[-+/_=]+"),
)

# The usual pairs of letters inside words.
PAIRS = frozenset(
    """ab ac ad af ag ai al am an ap ar as at au av ay ba be bi bl bo br bu ca ce ch ci ck cl
    co cr ct cu da de di do du ea ec ed ee ef el em en ep er es et ev ew ex ey fa fe ff fi fl
    fo fr fu ga ge gh gi gn go gr ha he hi ho ia ic id ie if ig il im in io ir is it iv ke ki
    la ld le li ll lo ls lu ly ma me mi mo mp mu na nc nd ne nf ng ni no ns nt nu ob oc od of
    oi ol om on oo op or os ot ou ov ow pa pe ph pi pl po pp pr pt pu qu ra rc rd re ri rm rn
    ro rr rs rt ru ry sa sc se sh si so sp sq ss st su sy ta te th ti tl to tr ts tt tu ty ub ue
    ui ul um un up ur us ut va ve vi wa we wi wo ye yp ys""".split()
)
# Share of a window's pairs from which it reads as names and not as a random string.
NAME_SHARE = 0.6


def _pair(a: str, b: str) -> tuple[int, int]:
    """(usual, counted) for neighbours: joins, pairs of digits and the step from a small to
    a capital letter do not count; a character, or the next one, after itself is usual."""
    if not (a.isalnum() and b.isalnum()) or (a.isdigit() and b.isdigit()) or (a.islower() and b.isupper()):
        return 0, 0
    return int(0 <= ord(b) - ord(a) <= 1 or (a + b).lower() in PAIRS), 1


@dataclass
class Window:
    """Counts of a sliding window, the sum of n log2 n over them, and its pairs of letters."""

    counts: dict[str, int] = field(default_factory=dict)
    mass: float = 0.0
    usual: int = 0
    pairs: int = 0

    def join(self, pair: tuple[int, int], by: int) -> None:
        self.usual += by * pair[0]
        self.pairs += by * pair[1]

    def names(self) -> bool:
        """Whether the window reads as names."""
        return self.usual >= NAME_SHARE * self.pairs

    def add(self, char: str, by: int) -> None:
        n = self.counts.get(char, 0)
        self.mass += _term(n + by) - _term(n)
        self.counts[char] = n + by


_TERMS = [0.0] + [n * math.log2(n) for n in range(1, 257)]


def _term(n: int) -> float:
    return _TERMS[n] if n < len(_TERMS) else n * math.log2(n)


def entropy_spans(text: str, classes=CLASSES, allowed=ALLOWED) -> list[tuple[int, int]]:
    """Joined windows of high entropy in the candidates of ``text``."""
    spans = []
    for first, value, kind in _scored(text, classes, allowed):
        open_ = None
        for start, end in _windows(value, kind):
            start, end = first + start, first + end
            if open_ and start <= open_[1]:
                open_[1] = end
            else:
                open_ = [start, end]
                spans.append(open_)
    return [(a, b) for a, b in spans]


def candidate_spans(text: str, classes=CLASSES, allowed=ALLOWED) -> list[tuple[int, int]]:
    """Whole candidates of ``text`` that have a window of high entropy."""
    return [
        (first, first + len(value))
        for first, value, kind in _scored(text, classes, allowed)
        if next(_windows(value, kind), None)
    ]


def _scored(text: str, classes, allowed) -> Iterator[tuple[int, str, CharClass]]:
    """Start, string and class of the candidates that are not allowed."""
    for found in CANDIDATE.finditer(text):
        value = found.group()
        kind = next((c for c in classes if c.member.fullmatch(value)), None)
        if kind and not any(p.fullmatch(value) for p in allowed):
            yield found.start(), value, kind


def _windows(value: str, kind: CharClass) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows at or above the threshold of ``kind`` that do not read
    as names."""
    window, width = Window(), min(kind.width, len(value))
    pairs = [_pair(a, b) for a, b in zip(value, value[1:])]
    for i, char in enumerate(value):
        window.add(char, 1)
        if i:
            window.join(pairs[i - 1], 1)
        if i >= width:
            window.add(value[i - width], -1)
            window.join(pairs[i - width], -1)
        if i + 1 < width or window.names():
            continue
        if math.log2(width) - window.mass / width >= kind.bits - 1e-9:
            yield i + 1 - width, i + 1


def pattern_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of known secrets, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def all_spans(text: str, base: list[tuple[int, str, int]] | None = None) -> list[tuple[int, str, int]]:
    """Pattern spans, ``base`` if known, and entropy spans, by start and then kind."""
    found = (pattern_spans(text) if base is None else base) + [(a, "entropy", b) for a, b in candidate_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with a mark instead of each run of touching or nested spans."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


RESULT = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans string, n_entropy long"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = pattern_spans(text)
            spans = all_spans(text, base)
            kinds = [k for _, k, _ in spans]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*map(kinds.count, KINDS[:3]), digest, _joined(spans), kinds.count("entropy")))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
        )


def scanned(docs: DataFrame) -> DataFrame:
    """Numbers and places of secrets for every row of ``docs``.

    spans holds kind:start:end of all spans in code points, end exclusive;
    base_sha256 is the digest of the pattern spans alone, so of an empty string
    where there are none. Null texts count as empty, null ids stay, repeated rows
    get equal results; other columns are not read. A text is scanned whole.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, RESULT)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced by its kind in angle brackets.

    Texts without one, null ones too, stay as they are; n_chars, if there is such
    a column, follows a changed text. Rows and other columns stay.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                if text and (spans := all_spans(text)):
                    changed[i] = redacted(text, spans)
            columns = list(batch.columns)
            if changed:
                for i, text in changed.items():
                    texts[i] = text
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                if chars_at is not None:
                    sizes = columns[chars_at].to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    columns[chars_at] = pa.array(sizes, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
