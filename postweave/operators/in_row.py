"""Sums and counts over the words of a post where its words are: no row per word.

The words' table goes to every task, so these serve tables of a checked size; the
callers join larger ones by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.session import BROADCAST_ROWS


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> pa.Table | None:
    """``table`` on the driver if it has at most ``most`` rows."""
    found = table.limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def word_places(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word of the lists that is among ``terms``."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    places = pc.index_in(lists.flatten().cast(terms.type), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), n)
    known = places >= 0
    return rows[known], places[known].astype(np.int64)


# Words of the rows that are looked up at once.
WORDS_AT_ONCE = 500_000


def portions(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts whose lists in column ``at`` hold about as many words
    as are looked up at once, so that memory does not follow the length of the posts."""
    n = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n) // WORDS_AT_ONCE
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(ends, ends[1:]):
        yield batch.slice(a, b - a)


def row_sums(df: DataFrame, keep: Sequence[str], words: Column, table: pa.Table, key: str) -> DataFrame:
    """(keep.., a sum for each other column of ``table``) over the words of each row.

    Unknown words and missing values count 0; a row without words stays.
    """
    values = [c for c in table.column_names if c != key]
    terms = table.column(key).combine_chunks()
    numbers = [pc.fill_null(table.column(c).cast(pa.float64()), 0.0).to_numpy() for c in values]
    shared = df.sparkSession.sparkContext.broadcast((terms, numbers))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = shared.value
        for batch in (part for whole in batches for part in portions(whole, len(keep))):
            rows, places = word_places(batch.column(len(keep)), terms)
            sums = [pa.array(np.bincount(rows, v[places], batch.num_rows).astype(float)) for v in numbers]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *sums], names=[*keep, *values])

    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(v, T.DoubleType()) for v in values]])
    return df.select(*keep, words.alias("_words")).mapInArrow(work, schema)


def row_counts(df: DataFrame, keep: Sequence[str], words: Column, terms: pa.Array) -> DataFrame:
    """(keep.., term, n): how often each of ``terms`` is among the words of a row."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in (part for whole in batches for part in portions(whole, len(keep))):
            rows, places = word_places(batch.column(len(keep)), terms)
            cells, n = np.unique(rows * max(len(terms), 1) + places, return_counts=True)
            row, place = np.divmod(cells, max(len(terms), 1))
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[: len(keep)]]
            found = terms.take(pa.array(place, pa.int64())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*kept, found, pa.array(n, pa.int64())], names=[*keep, "term", "n"])

    more = [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    return df.select(*keep, words.alias("_words")).mapInArrow(work, T.StructType([*[df.schema[c] for c in keep], *more]))
