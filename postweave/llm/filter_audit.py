"""What five document filters remove, alone and in every order of application.

Words are encoded by one dictionary of all documents, and the documents become
shards of a sparse document-term matrix in compressed row form. Row sums and
numbers of entries decide the two filters on words; three more flags come from
the text and from equal texts of other documents. Documents are then counted per
source and set of failed filters, and these few counts give all 120 orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import Staging, prepare
from postweave.llm.ragged import portions, split_words

FILTERS = "ABCDE"
MIN_WORDS = 200
# Per cent of the words that must be distinct, and of code points that may be A-Z.
MIN_DISTINCT = 50
MAX_CAPITALS = 2
MARKS = "#$%&*|"
# Bytes of text in one shard; a longer text is a shard of its own.
PORTION = 8 << 20

_MARKED = np.zeros(256, bool)
_MARKED[list(MARKS.encode())] = True


def pack(counts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> bytes:
    """A matrix in compressed row form: entries per row, their columns and values."""
    head = np.array([len(counts), len(columns)], np.int64)
    parts = [head, counts.astype(np.int64), columns.astype(np.int64), values.astype(np.int32)]
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(packed)
    rows, entries = np.frombuffer(data, np.int64, 2)
    counts = np.frombuffer(data, np.int64, rows, 16)
    columns = np.frombuffer(data, np.int64, entries, 16 + 8 * rows)
    return counts, columns, np.frombuffer(data, np.int32, entries, 16 + 8 * (rows + entries))


def local_matrix(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts, and the matrix with their places as columns."""
    words, counts = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    cells, values = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    entries = np.bincount(cells // width, minlength=len(counts))
    return coded.dictionary, entries, cells % width, values


def _at(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of flagged bytes between the ends of texts."""
    return np.diff(np.searchsorted(np.flatnonzero(flag), ends))


def marks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A-Z, code points and listed marks of each text."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and ends[-1] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    capitals = _at((data >= 65) & (data <= 90), ends)
    points = np.diff(ends) - _at((data & 0xC0) == 0x80, ends)
    return capitals, points, _at(_MARKED[data], ends)


def blocks(docs: DataFrame) -> DataFrame:
    """Shards before encoding: the documents' flags, matrix of local words, the words."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            first = 0
            for part in portions(batch.column(3), PORTION):
                words, entries, columns, values = local_matrix(part)
                capitals, points, marks = marks_of(part)
                docs_of = pa.StructArray.from_arrays(
                    [
                        *[batch.column(c).slice(first, len(part)) for c in range(3)],
                        pa.array(100 * capitals > MAX_CAPITALS * points),
                        pa.array(marks > 0),
                    ],
                    names=["doc_id", "part", "digest", "c", "d"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(task << 32) + n]),
                        pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), docs_of),
                        pa.array([pack(entries, columns, values)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                    ],
                    names=["block", "docs", "matrix", "words"],
                )
                first += len(part)
                n += 1

    return rows.mapInArrow(
        work,
        "block long, docs array<struct<doc_id:long,part:string,digest:binary,c:boolean,d:boolean>>, "
        "matrix binary, words array<string>",
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in order: a number for each new one, its text only where it is new."""
    from pyspark import TaskContext

    at, last = (TaskContext.get().partitionId() << 33) - 1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word")
        fresh = np.ones(len(words), bool)
        fresh[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = words[0].as_py() != last
        ids = at + np.cumsum(fresh)
        at, last = int(ids[-1]), words[-1].as_py()
        new = pc.if_else(pa.array(fresh), words, pa.scalar(None, words.type))
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), batch.column("place"), pa.array(ids), new], names=["block", "place", "id", "word"]
        )


def dictionary(staging: Staging, words: DataFrame) -> DataFrame:
    """(block, place, id, word): the number of each word, dense from 0; ``word`` is
    given once for each number, so these rows are the dictionary."""
    dealt = words.repartition("word").sortWithinPartitions("word")
    found = staging(dealt.mapInArrow(_numbered, "block long, place int, id long, word string"), "audit-words")
    found = found.withColumn("part", F.shiftright("id", 33))
    # One row per task that has numbered words.
    sizes = sorted((r.part, r.n) for r in found.groupBy("part").agg(F.count("word").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    starts = staging.spark.createDataFrame(starts, "part long, start long")
    dense = (F.col("start") + F.col("id") - F.shiftleft("part", 33)).cast("long")
    return found.join(F.broadcast(starts), "part").select("block", "place", dense.alias("id"), "word")


def _encoded(shard: pa.Table, ids: pa.Table) -> pa.Table:
    """A shard with the ids of its words as columns."""
    entries, columns, values = unpack(shard.column("matrix")[0].as_py())
    own = np.empty(len(ids), np.int64)
    own[ids.column("place").to_numpy()] = ids.column("id").to_numpy()
    packed = pa.array([pack(entries, own[columns] if len(columns) else columns, values)], pa.binary())
    return pa.Table.from_arrays([shard.column("block"), shard.column("docs"), packed], ["block", "docs", "matrix"])


def matrix_shards(staging: Staging, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The encoded shards (block, docs, matrix), stored, and the dictionary (word, id).

    A word is sent once per shard that holds it, whatever its number of places.
    """
    local = staging(blocks(docs), "audit-blocks")
    words = local.select("block", F.posexplode("words").alias("place", "word"))
    known = dictionary(staging, words)
    coded = known.select("block", "place", "id")
    kept = local.select("block", "docs", "matrix")
    shards = staging(
        kept.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_encoded, kept.schema), "audit-shards"
    )
    staging.drop(local)
    return shards, known.filter("word is not null").select("word", "id")


def word_flags(shards: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): bits of the filters A to D that a document fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, packed in zip(batch.column(0), batch.column(1), strict=True):
                entries, _, values = unpack(packed.as_py())
                ends = np.cumsum(entries)
                total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                sums = total[ends] - total[ends - entries]
                rows = docs.values
                fails = [
                    sums < MIN_WORDS,
                    100 * entries < MIN_DISTINCT * sums,
                    *[rows.field(c).to_numpy(zero_copy_only=False) for c in ("c", "d")],
                ]
                mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.field(c) for c in ("doc_id", "part", "digest")], pa.array(mask, pa.int32())],
                    names=["doc_id", "part", "digest", "mask"],
                )

    return shards.select("docs", "matrix").mapInArrow(work, "doc_id long, part string, digest binary, mask int")


def fail_counts(staging: Staging, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per source and set of failed filters."""
    shards, _ = matrix_shards(staging, docs)
    rows = staging(word_flags(shards), "audit-flags")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staging(firsts.filter("n > 1").select("digest", "first"), "audit-copies")
    marked = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    rows = rows.join(firsts, "digest", "left").join(marked, "doc_id", "left")
    return rows.groupBy("part", F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def orders_of(counts: np.ndarray) -> list[tuple]:
    """(filter_order, step, counts..) of all orders, from counts[n, good, toxic][mask]."""
    masks = np.arange(1 << len(FILTERS))
    n = counts[0]
    rows, shapley = [], np.zeros(len(FILTERS), np.int64)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            fails, fresh = masks >> f & 1 == 1, masks & before == 0
            removed = fails & fresh
            before |= 1 << f
            shapley[f] += n[removed].sum()
            rows.append(
                [
                    "".join(FILTERS[k] for k in order), step, n[masks & before == 0].sum(), n[removed].sum(),
                    n[fails & ~fresh].sum(), n[1 << f], counts[1][removed].sum(), counts[2][removed].sum(), f,
                ]
            )
    return [(*row[:2], *map(int, row[2:-1]), int(shapley[row[-1]])) for row in rows]


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per source: every order of the five filters, step by step.

    Null texts are empty ones, which fail A alone and, beside a smaller id with
    an empty text, E. A null source is the empty one. A document is a copy if a
    smaller id has the same text; one without an id is never a copy nor makes one,
    and has no label. Repeated rows count each; of several labels of an id any
    that marks it counts. Other columns are not read. Without documents there is
    no source and no row.
    """
    prepare(spark)
    counts = fail_counts(Staging(spark), docs, labels)
    # At most 32 rows a source.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                table = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for row in found:
                    table[:, row["mask"]] = row["n"], row["good"], row["toxic"]
                columns = list(zip(*orders_of(table), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.RecordBatch.from_arrays(
                    [pc.fill_null(pa.array([part.as_py()] * len(columns[0]), pa.string()), ""),
                     *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return parts.mapInArrow(work, RESULT)
