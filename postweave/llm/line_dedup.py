"""Substring deduplication by hashing units of lines across all documents.

A line is cut after sentence ends into units. Units are normalised and hashed,
digests grouped globally, and the occurrence ranked first, by document and then
by place, is kept. Touching units that are repeats form runs; runs of enough
words are removed, and their original offsets are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.llm.common import Staging, prepare

# A run of repeated units is removed from so many words on.
MIN_WORDS = 20
# A unit ends with its line, or at white space after a full stop or the like.
UNIT = re.compile(r"[^\n]*?(?:[.!?](?=\s)|(?=\n)|\Z)")
UNITS = "doc_id long, text_key long, unit int, start int, end int, words int, digest long"


def units_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of the units of a text that hold a word.

    The normal form is in lower case with single blanks; offsets are code points.
    """
    out = []
    for found in UNIT.finditer(text):
        words = found.group().lower().split()
        if words:
            lead = len(found.group()) - len(found.group().lstrip())
            out.append((found.start() + lead, found.end(), len(words), " ".join(words)))
    return out


def units(docs: DataFrame) -> DataFrame:
    """One row per unit of ``docs``; null and empty texts have none."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(2)):
                found = units_of(text.as_py() or "")
                owner += [i] * len(found)
                rows += [(k, a, b, n, xxhash.xxh64_intdigest(s)) for k, (a, b, n, s) in enumerate(found)]
                if len(rows) >= 100_000:
                    yield _batch(batch, owner, rows)
                    owner, rows = [], []
            yield _batch(batch, owner, rows)

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].alias("text")
    ).mapInArrow(work, UNITS)


def _batch(batch: pa.RecordBatch, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c).take(pa.array(owner, pa.int64())) for c in range(2)],
            *[pa.array(c, pa.int32()) for c in columns[:4]],
            pa.array(np.array(columns[4], np.uint64).view(np.int64)),
        ],
        names=["doc_id", "text_key", "unit", "start", "end", "words", "digest"],
    )


def repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Removed runs: doc_id, start, end, n_units, n_words, kept_doc_id, kept_start, text_key.

    ``kept_doc_id`` and ``kept_start`` say where the run's first unit is kept. A
    unit repeated inside its own document is a repeat too. A document is an id and
    a text, whose hash is ``text_key``: rows that share both are one document, rows
    without an id are one per text. Documents are ranked by id, null last, and then
    by the hash. Whole copies are one run from end to end. Clean documents have no
    row; an empty table gives none.
    """
    staging = Staging(spark)
    cut = staging(units(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1))), "units")
    place = F.struct("doc_id", "text_key", "unit", "start")
    first = cut.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("latest"))
    # Only digests that occur at two places.
    first = first.filter("first < latest").select(
        "digest", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.text_key").alias("kept_text"),
        F.col("first.unit").alias("kept_unit"), F.col("first.start").alias("kept_start"),
    )
    # Stored, so that both sides of the join are dealt anew and a digest with very
    # many places is split over tasks.
    first = staging(first, "first-places")
    again = cut.join(first, "digest").filter(
        "doc_id > kept_doc_id or text_key <> kept_text or unit > kept_unit"
    )
    # Dealt by document here, so that the join before may be split and all that
    # follows needs no other exchange. One document has as many units as its text.
    again = again.repartition("doc_id", "text_key")
    own = Window.partitionBy("doc_id", "text_key").orderBy("unit")
    runs = again.dropDuplicates(["doc_id", "text_key", "unit"]).withColumn(
        "run", F.col("unit") - F.row_number().over(own)
    )
    found = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("words").alias("n_words"),
        F.min(F.struct("unit", "kept_doc_id", "kept_start")).alias("kept"),
    )
    unknown = F.lit(2**63 - 1)
    return found.filter(F.col("n_words") >= min_words).select(
        F.nullif("doc_id", unknown).alias("doc_id"), "start", "end", "n_units", "n_words",
        F.nullif(F.col("kept.kept_doc_id"), unknown).alias("kept_doc_id"),
        F.col("kept.kept_start").alias("kept_start"), "text_key",
    )


def without_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed runs cut out of their texts, and removed_spans.

    removed_spans holds the (start, end) in the original text by start, so the
    cut can be undone; it is empty, and the text as it was, for clean documents.
    Rows that share an id are cut by their own texts alone.
    """
    known, key = F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)), F.xxhash64(docs["text"])
    spans = repeats(spark, docs, min_words).groupBy(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("cut_id"), F.col("text_key").alias("cut_key")
    ).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(
        known.alias("own_id"), key.alias("own_key"), F.struct(*[docs[c] for c in docs.columns]).alias("row")
    ).join(spans, (F.col("own_id") == F.col("cut_id")) & (F.col("own_key") == F.col("cut_key")), "left")
    whole = F.col("row.text")
    kept = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"])).alias("out"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.char_length(whole))),
    )
    fields = [
        (F.when(F.col("spans").isNull(), whole).otherwise(kept) if c == "text" else F.col("row")[c]).alias(c)
        for c in docs.columns
    ]
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(*fields, F.coalesce("spans", none).alias("removed_spans"))
