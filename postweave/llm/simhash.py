"""SimHash near-duplicates through one-wildcard segment variants.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints
that differ in at most two bits, one segment is equal or both differ in one bit,
so the links are found by equality joins on: either whole segment, and the first
segment with one bit struck out, once for each bit. Every match is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from postweave.llm.common import Staging, components, prepare
from postweave.llm.ragged import portions, split_words

SHINGLE = 3
SEED = 42
MAX_BITS = 2
# Bytes of text whose shingles are held at once; a longer text is held alone.
PORTION = 2 << 20
# Shingles whose bits are unpacked at once.
SLICE = 1 << 16


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of them per text."""
    words, counts = split_words(texts)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    full = counts >= SHINGLE
    if len(words) >= SHINGLE:
        ends = len(words) - SHINGLE + 1
        joined = pc.binary_join_element_wise(*[words.slice(k, ends) for k in range(SHINGLE)], pa.scalar(" ", pa.large_string()))
    else:
        joined = pa.array([], pa.large_string())
    first = np.repeat(starts, np.where(full, n, 0))
    within = np.arange(len(first)) - np.repeat(
        np.cumsum(np.where(full, n, 0)) - np.where(full, n, 0), np.where(full, n, 0)
    )
    hashed = _hash(joined.take(pa.array(first + within)).cast(pa.large_binary()).to_pylist())
    out = np.zeros(int(n.sum()), np.uint64)
    is_full = np.repeat(full, n)
    out[is_full] = hashed
    short = [" ".join(words.slice(s, c).to_pylist()).encode() for s, c in zip(starts[~full], counts[~full], strict=True) if c]
    out[~is_full] = _hash(short)
    return out, n


def _hash(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, values, repeat(SEED)), np.uint64, len(values))


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is set if over half of the text's hashes have it; none: zero."""
    votes = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, len(hashes), SLICE):
        part, own = hashes[a : a + SLICE], owner[a : a + SLICE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    set_bits = 2 * votes > counts[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for part in portions(batch.column(1), PORTION):
            found = fingerprints(*shingle_hashes(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(part)), pa.array(found.view(np.int64))],
                names=["key", "fp"],
            )
            first += len(part)


def marked(docs: DataFrame, key: Column) -> DataFrame:
    """(key, fp): ``key`` of each document and its fingerprint as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(key.alias("key"), docs["text"].alias("text"))
    return rows.mapInArrow(_marked, rows.select("key").schema.add("fp", LongType()))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a below b: all pairs of distinct fingerprints within two bits."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    whole = distinct.select(
        "fp", F.explode(F.array(high.bitwiseOR(1 << 40), low.bitwiseOR(2 << 40))).alias("slot")
    )
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    equal = whole.alias("x").join(
        whole.alias("y"),
        (F.col("x.slot") == F.col("y.slot")) & (F.col("x.fp") < F.col("y.fp")) & near,
    )
    # Bit i struck out: those without it on one side, those with it on the other.
    bits = distinct.select("fp", high.alias("high"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    bit = F.expr("shiftleft(1L, i)")
    struck = bits.select(
        "fp",
        F.col("high").bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.expr("shiftleft(CAST(i AS LONG) + 1, 33)")).alias("slot"),
        (F.col("high").bitwiseAND(bit) != 0).alias("on"),
    )
    wild = struck.filter(~F.col("on")).alias("x").join(
        struck.filter("on").alias("y"), (F.col("x.slot") == F.col("y.slot")) & near
    )
    pairs = equal.select("x.fp", "y.fp").union(wild.select("x.fp", "y.fp")).toDF("p", "q")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _placed(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """(fp, least, component) of the stored distinct fingerprints (fp, least)."""
    found = components(spark, links(prints.select("fp")))
    return prints.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts without words, null ones among them, have fingerprint zero and link
    like any other. Fingerprints are joined, not documents, so copies cost
    nothing. A component's id is its smallest doc_id; null ids count last and
    only a component of nothing else has a null id. Repeated rows stay.
    """
    staging = Staging(spark)
    rows = staging(marked(docs, F.col("doc_id").cast("long")), "fingerprints")
    distinct = staging(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    placed = _placed(spark, distinct)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = placed.join(named, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def first_of_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of ``groups``, with all columns of ``docs``.

    The row with the smallest id stays, null ids last; of several with that id
    the one with the smallest hash of all its columns. Equal rows are one. So a
    group keeps one row whatever its ids, and an empty table gives none.
    """
    staging = Staging(spark)
    whole = F.struct(*[docs[c] for c in docs.columns])
    none = docs["doc_id"].isNull()
    # Never null, so the join below and the grouping share one exchange.
    place = F.struct(
        none.alias("none"), F.coalesce(docs["doc_id"], F.lit(0)).cast("long").alias("id"),
        F.xxhash64(whole).alias("row_key"),
    )
    prints = staging(marked(docs, place).groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    firsts = _placed(spark, prints).groupBy("component").agg(F.min("least").alias("first")).select("first.*")
    # Equal rows become one before they are dealt out.
    rows = docs.select(place.alias("place"), whole.alias("row")).groupBy(
        *[F.col(f"place.{c}").alias(c) for c in firsts.columns]
    ).agg(F.any_value("row").alias("row"))
    return rows.join(firsts, firsts.columns, "left_semi").select("row.*")
