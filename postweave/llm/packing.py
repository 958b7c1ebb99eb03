"""Bound-certified best-fit packing of token pieces into sequences.

Pieces are dealt into cells of a bounded size, each packed by best-fit
decreasing. Dual-feasible functions give a lower bound on a cell's sequences; a
cell that meets it is certified. Cells with a gap, and the emptiest sequence of
every cell, give their pieces up for exchange, and these are packed again with
those of other cells, for as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.bpe import tokenizer, vocabulary
from postweave.llm.common import Staging, prepare
from postweave.llm.ragged import portions
from postweave.llm.token_counts import VOCABULARY

CAPACITY = 4096
END = 1
# Pieces of a cell on average: what one task holds and packs at once.
CELL = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, cell long, bin long, offset long, loose boolean"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every row of ``docs``: one, or several for a long text.

    A document is its ids and the end id, so a null or empty text is one piece of
    one token. Repeated rows give repeated pieces; null ids stay null; columns
    other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary(VOCABULARY))
        for batch in batches:
            doc_ids = batch.column(0)
            first = 0
            for part in portions(batch.column(1)):
                yield _cut(doc_ids.slice(first, len(part)), *bpe.encode(part), capacity)
                first += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def _cut(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int) -> pa.RecordBatch:
    whole = np.insert(ids, np.cumsum(counts), END).astype("<u4")
    lengths = counts + 1
    n = -(-lengths // capacity)
    owner = np.repeat(np.arange(len(n)), n)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(lengths[owner] - start, capacity)
    at = (np.cumsum(lengths) - lengths)[owner] + start
    sums = [zlib.crc32(whole[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start),
         pa.array(length), pa.array(sums, pa.int64())],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of ``lengths`` needs fewer bins, by two families of functions.

    The first counts pieces above capacity - e as whole bins, those from e by
    their length and smaller ones not at all; the second rounds lengths down to
    multiples of capacity / (k + 1), unless they are such multiples.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * size)
    e = np.arange(0, capacity // 2 + 1)
    below = np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)
    whole = (number[-1] - number[capacity - e]) * capacity + volume[capacity - e] - below
    best = int(-(-whole.max() // capacity))
    for k in range(1, 33):
        parts = (k + 1) * size // capacity
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, parts * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece by best-fit decreasing, and the space left per bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    mask = 0  # bit r: some bin has r tokens left
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = open_bins[space].pop()
            if not open_bins[space]:
                mask ^= 1 << space
        else:
            space, own = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = own, capacity - space
        space -= length
        left[own] = space
        if space:
            open_bins[space].append(own)
            mask |= 1 << space
    return bins, offsets, left


def _pack_cell(capacity: int):
    def work(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        space = np.array(left)
        gap = len(left) > lower_bound(lengths, capacity)
        loose = space == space.max()
        if loose.sum() > 1:  # one emptiest bin
            loose[np.flatnonzero(loose)[1:]] = False
        loose &= space > 0
        if gap:
            loose = space > 0
        for name, value in (("bin", bins), ("offset", offsets), ("loose", loose[bins])):
            table = table.append_column(name, pa.array(value))
        return table

    return work


def _dealt(rows: DataFrame, n: int, first: int) -> DataFrame:
    """Cells ``first`` to first + n - 1, dealt evenly whatever the ids are."""
    cell = F.pmod(F.xxhash64(F.col("doc_id"), F.col("piece"), F.monotonically_increasing_id()), F.lit(n))
    return rows.withColumn("cell", (cell + first).cast("long"))


def packed(
    spark: SparkSession,
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    cell: int = CELL,
) -> DataFrame:
    """All pieces with sequence_id and offset; no documents give no rows.

    Pieces as long as a sequence are sequences of their own. Cells bound what a
    task holds; exchange crosses them, so the result does not depend on one.
    """
    staging = Staging(spark)
    # Stored with their cells: numbers given while reading are not drawn again.
    found = staging(pieces(docs, path, capacity), "pieces")
    full = found.filter(F.col("length") == capacity).select(
        *found.columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    open_ = found.filter(F.col("length") < capacity)
    results, given, before, cells = [], open_, None, 0
    while True:
        n_pieces = given.count()
        if n_pieces == 0:
            break
        n = -(-n_pieces // cell)
        dealt = staging(_dealt(given, n, cells), "cells")
        cells += n
        tried = staging(
            dealt.groupBy("cell").applyInArrow(_pack_cell(capacity), PACKED), "packed"
        )
        bins, loose_bins = tried.filter("offset = 0").agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.col("loose").cast("long")), F.lit(0))
        ).first()
        staging.drop(dealt)
        if before is not None and bins >= before[1]:
            # No sequence saved: what was given up stays as it was packed.
            results.append(before[0].filter("loose"))
            break
        if loose_bins < 2:
            results.append(tried)
            break
        results.append(tried.filter(~F.col("loose")))
        given = tried.filter("loose").select(*found.columns)
        before = (tried, loose_bins)
    out = full
    for rows in results:
        number = F.col("cell") * (1 << 20) + F.col("bin")
        out = out.unionByName(rows.select(*found.columns, number.alias("sequence_id"), "offset"))
    return out
