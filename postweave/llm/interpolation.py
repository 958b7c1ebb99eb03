"""Language-model scores by deleted interpolation of unigrams and bigrams.

Texts are cut into blocks that are stored as arrays of word numbers. Counts are
looked up by request and reply: a block sends each distinct key once, keys are
dealt by hash range, summed, and every block gets the totals of its keys back in
their order. So a frequent word is one entry per block, and nothing but blocks
and ranges of bounded size is ever held in one task.

The probability of a token is a mixture of a uniform share, its frequency and its
frequency after the token before it. The weights depend on how often that context
was seen (by powers of two) and are learned by expectation-maximisation on counts
of training texts that were held out from the estimates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import Staging, prepare
from postweave.llm.ragged import portions, split_words, sums

# Texts whose id has this remainder are never learned from; of the others, those
# with the second remainder are held out from the estimates for the weights.
FOLDS, HELD_OUT, TUNING = 7, 2, 3
BLOCK_BYTES = 8 << 20
# Keys of a hash range on average: what one task adds up.
RANGE = 2_000_000
# Keys that stand for the end of a text and for the place before its first token.
END, BEGIN = np.uint64(1), np.uint64(2)
# Steps per power of two in which probability ratios are gathered for the weights.
STEPS = 4
ROUNDS = 200
PRIOR = (0.1, 0.3, 0.6)

BLOCKS = (
    "block long, ids array<long>, parts binary, sizes binary, tokens binary, words binary, "
    "n_keys long, n_pairs long, n_texts long, n_tuning long"
)
ASKED = "block long, range int, keys binary, train binary, tuning binary, context binary"
TOLD = (
    "block long, range int, kind string, train binary, tuning binary, "
    "n long, n_tuning long, distinct long, kept long, cells array<struct<code:long,weight:long>>"
)
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the smallest width that holds them, byte by byte, compressed."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w or w == 8)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(data[0], -1).T).view(f"<u{data[0]}")
    return values.reshape(-1).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit key per pair of word keys."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Range of each key, rising with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def part_of(doc_id: int | None) -> int:
    """0: learned from, 1: held out for the weights, 2: never learned from.

    A text without an id is learned from.
    """
    if doc_id is None:
        return 0
    rest = zlib.crc32(str(doc_id).encode()) % FOLDS
    return 2 if rest == HELD_OUT else int(rest == TUNING)


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as word numbers, several to a row; null texts are empty."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            first = 0
            for texts in portions(batch.column(1), BLOCK_BYTES):
                ids = batch.column(0).slice(first, len(texts)).to_pylist()
                first += len(texts)
                yield _block(number, ids, texts)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, BLOCKS)


def _block(number: int, ids: list, texts: pa.Array) -> pa.RecordBatch:
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    raw = coded.dictionary.cast(pa.large_binary()).to_pylist()
    keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
    keys, place = np.unique(np.r_[keys, END], return_inverse=True)
    indices = place[coded.indices.to_numpy(zero_copy_only=False)] if len(raw) else np.zeros(0, np.int64)
    tokens = np.insert(indices, np.cumsum(counts), place[-1])
    sizes = counts + 1
    parts = np.array([part_of(i) for i in ids], np.int64)
    pairs = len(np.unique(_pairs(keys, tokens, sizes)))
    values = [
        number, ids, pack(parts), pack(sizes), pack(tokens), pack_keys(keys), len(keys), pairs,
        int((parts < 2).sum()), int((parts == 1).sum()),
    ]
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, *[pa.int64()] * 4]
    names = ["block", "ids", "parts", "sizes", "tokens", "words", "n_keys", "n_pairs", "n_texts", "n_tuning"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _pairs(keys: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it."""
    own = keys[tokens]
    before = np.r_[BEGIN, own[:-1]] if len(own) else own
    before[np.cumsum(sizes) - sizes] = BEGIN
    return pair_keys(before, own)


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    return unpack(row["parts"]), unpack(row["sizes"]), unpack(row["tokens"]), unpack_keys(row["words"])


def _asked(block: int, keys: np.ndarray, train, tuning, n: int, context=None) -> pa.Table:
    """Requests of a block, one per range; keys are sorted."""
    at = ranges(keys, n)
    rows = []
    for r in np.unique(at).tolist():
        a, b = np.searchsorted(at, [r, r + 1])
        more = None if context is None else _context(tuning[a:b], context[:, a:b])
        rows.append((block, r, pack_keys(keys[a:b]), pack(train[a:b]), pack(tuning[a:b]), more))
    columns = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    names = ["block", "range", "keys", "train", "tuning", "context"]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _context(tuning: np.ndarray, context: np.ndarray) -> bytes:
    return pack(context[:, tuning > 0].ravel())


def word_requests(stored: DataFrame, n: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts, sizes, tokens, keys = _opened(row)
                part = np.repeat(parts, sizes)
                train = np.bincount(tokens[part < 2], minlength=len(keys))
                tuning = np.bincount(tokens[part == 1], minlength=len(keys))
                yield from _asked(row["block"], keys, train, tuning, n).to_batches()

    return stored.select("block", "parts", "sizes", "tokens", "words").mapInArrow(work, ASKED)


def _told(kind: str, totals: Totals | None = None):
    """Adds up a range and answers each block that asked."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack_keys(r["keys"]) for r in rows]
        train = np.concatenate([unpack(r["train"]) for r in rows])
        tuning = np.concatenate([unpack(r["tuning"]) for r in rows])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        all_train = np.bincount(place, train, len(distinct)).astype(np.int64)
        all_tuning = np.bincount(place, tuning, len(distinct)).astype(np.int64)
        cells = [] if totals is None else _cells(rows, tuning, (all_train - all_tuning)[place], totals)
        out, first = [], 0
        for k, (row, own) in enumerate(zip(rows, keys, strict=True)):
            at = place[first : first + len(own)]
            first += len(own)
            out.append((
                row["block"], row["range"], kind, pack(all_train[at]),
                pack(all_tuning[at]) if totals is None else None,
                *((int(all_train.sum()), int(all_tuning.sum()), int((all_train > 0).sum()),
                   int((all_train > all_tuning).sum()), cells) if k == 0 else (0, 0, 0, 0, [])),
            ))
        columns = list(zip(*out, strict=True))
        cell = pa.struct([("code", pa.int64()), ("weight", pa.int64())])
        types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(cell)]
        names = ["block", "range", "kind", "train", "tuning", "n", "n_tuning", "distinct", "kept", "cells"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return work


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones and texts; the same without those held out."""

    tokens: int
    distinct: int
    texts: int
    kept_tokens: int
    kept_distinct: int
    kept_texts: int


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 plus the whole part of the binary logarithm."""
    return np.frexp(counts.astype(np.float64))[1]


def _step(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.round(np.log2(ratio) * STEPS) + 512, 0).astype(np.int64)


def _cells(rows: list[dict], tuning: np.ndarray, pair: np.ndarray, totals: Totals) -> list[dict]:
    """Held-out counts by context bucket and by the ratios of the three estimates."""
    context = np.concatenate([unpack(r["context"]).reshape(2, -1) for r in rows], axis=1)
    held = tuning > 0
    weight, pair = tuning[held], pair[held]
    before, word = context
    share = totals.kept_distinct + 1
    ones = _step(word * share / max(1, totals.kept_tokens))
    twos = _step(np.where(before > 0, pair / np.maximum(before, 1), 0) * share)
    codes, place = np.unique((bucket(before) << 20) + (ones << 10) + twos, return_inverse=True)
    sums_ = np.bincount(place, weight, len(codes)).astype(np.int64)
    return [{"code": int(c), "weight": int(w)} for c, w in zip(codes, sums_, strict=True)]


def learned(cells: list[tuple[int, int]]) -> np.ndarray:
    """Weights (uniform, word, pair) per context bucket, by expectation-maximisation.

    ``cells`` are codes of at most 64 x 1024 x 1024 kinds with their held-out
    counts. Each weight starts with a pseudo-count of one, so none vanishes. A
    bucket without held-out counts takes the next lower one's weights, and an
    unseen context has no pair share.
    """
    weights = np.tile(np.array(PRIOR), (65, 1))
    codes = np.array([c for c, _ in cells], np.int64)
    counts = np.array([n for _, n in cells], np.float64)
    buckets = codes >> 20
    ratio = lambda q: np.where(q > 0, 2.0 ** ((q - 512) / STEPS), 0.0)
    values = np.stack([np.ones(len(codes)), ratio(codes >> 10 & 1023), ratio(codes & 1023)], axis=1)
    for b in range(65):
        own = buckets == b
        if not own.any():
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        v, n = values[own], counts[own]
        if b == 0:
            v[:, 2] = 0
        lam = np.array(PRIOR)
        for _ in range(ROUNDS):
            parts = v * lam
            share = (parts / parts.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + 1
            new = share / share.sum()
            settled = np.abs(new - lam).max() < 1e-7
            lam = new
            if settled:
                break
        weights[b] = lam
    weights[0, 2] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def _answers(rows: list[dict], kind: str, field: str) -> np.ndarray:
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["range"])
    return np.concatenate([unpack(r[field]) for r in own])


def _before(tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, begin: int) -> np.ndarray:
    """Count of each token's context."""
    out = np.r_[begin, counts[tokens[:-1]]]
    out[np.cumsum(sizes) - sizes] = begin
    return out


def _pair_requests(n: int, totals: Totals):
    def work(block: pa.Table, told: pa.Table) -> pa.Table:
        row, rows = block.to_pylist()[0], told.to_pylist()
        parts, sizes, tokens, words = _opened(row)
        kept = _answers(rows, "word", "train") - _answers(rows, "word", "tuning")
        part = np.repeat(parts, sizes)
        keys, at, place = np.unique(_pairs(words, tokens, sizes), return_index=True, return_inverse=True)
        train = np.bincount(place[part < 2], minlength=len(keys))
        tuning = np.bincount(place[part == 1], minlength=len(keys))
        before = _before(tokens, sizes, kept, totals.kept_texts)
        context = np.stack([before[at], kept[tokens[at]]])
        return _asked(row["block"], keys, train, tuning, n, context)

    return work


def _scores(totals: Totals, weights: np.ndarray):
    def work(block: pa.Table, told: pa.Table) -> pa.Table:
        row, rows = block.to_pylist()[0], told.to_pylist()
        parts, sizes, tokens, words = _opened(row)
        count = _answers(rows, "word", "train")
        _, place = np.unique(_pairs(words, tokens, sizes), return_inverse=True)
        pair = _answers(rows, "pair", "train")[place]
        own, before = count[tokens], _before(tokens, sizes, count, totals.texts)
        lam = weights[bucket(before)]
        p = lam[:, 0] / (totals.distinct + 1) + lam[:, 1] * own / max(1, totals.tokens)
        p = p + lam[:, 2] * pair / np.maximum(before, 1)
        base = np.log10((own + 1) / (totals.tokens + totals.distinct + 1))
        ends = np.cumsum(sizes)
        total = lambda x: np.add.reduceat(x, ends - sizes)
        arrays = [
            pa.array(row["ids"], pa.int64()), pa.array(parts == 2), pa.array(sizes),
            pa.array(sums((own > 0).astype(np.int64), sizes)),
            pa.array(np.full(len(sizes), totals.tokens)),
            pa.array(total(base)), pa.array(total(np.log10(p))),
        ]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays(arrays, names)

    return work


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs``, null and empty texts (one end token) included.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score, the model's log10 probability. Repeated rows are learned
    from and scored each. Words and pairs are told apart by 64-bit hashes. An
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    staging = Staging(spark)
    stored = staging(blocks(docs), "blocks")
    n_keys, n_pairs, texts, tuning = stored.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "n_pairs", "n_texts", "n_tuning")]
    ).first()
    words = staging(
        word_requests(stored, _parts(n_keys)).groupBy("range").applyInArrow(_told("word"), TOLD), "words"
    )
    n, n_tuning, distinct, kept = words.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_tuning", "distinct", "kept")]
    ).first()
    totals = Totals(n, distinct, texts, n - n_tuning, kept, texts - tuning)
    lean = stored.select("block", "ids", "parts", "sizes", "tokens", "words")
    word_told = words.select("block", "range", "kind", "train", "tuning")
    asked = (
        lean.groupBy("block")
        .cogroup(word_told.groupBy("block"))
        .applyInArrow(_pair_requests(_parts(n_pairs), totals), ASKED)
    )
    pairs = staging(asked.groupBy("range").applyInArrow(_told("pair", totals), TOLD), "pairs")
    # Bounded by the grid of ratios, whatever the input.
    cells = (
        pairs.select(F.explode("cells").alias("c")).groupBy("c.code").agg(F.sum("c.weight").alias("w")).collect()
    )
    weights = learned([(r["code"], r["w"]) for r in cells])
    told = word_told.drop("tuning").unionByName(pairs.select("block", "range", "kind", "train"))
    return lean.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _scores(totals, weights), SCORED
    )


def _parts(keys: int) -> int:
    return max(1, -(-keys // RANGE))
