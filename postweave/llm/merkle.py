"""A Merkle manifest of a table: a tree per language under one root, and proofs.

Only every few levels of a tree are stored. A proof needs siblings of every
level: those in between are computed again for one aligned subtree at a time
from its stored lowest nodes, handed out to these nodes, and forgotten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import Staging, prepare
from postweave.llm.numbering import placed
from postweave.session import broadcast_if_small

# Levels from one stored level to the next: subtrees of 256 nodes.
STEP = 8
DIGEST = 32
# Rows of one Arrow batch of results.
ROWS = 8192
# One document in so many is tampered with to see that its proof fails.
TAMPERED = 7


def digest_of(*parts: bytes) -> bytes:
    """SHA-256 of the digests' lowercase hex texts, one after another."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 byte count, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, n_chars: Column) -> Column:
    parts = [docs["doc_id"], docs["source"], docs["lang"], n_chars, docs["text"]]
    return F.unhex(F.sha2(F.concat(*[field(p) for p in parts]), 256))


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    return (total - 1).bit_length()


def upwards(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """``nodes`` and the given number of levels above them; the last run may be one."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest_of(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _levels_from(level: int, step: int, total: int) -> int:
    return max(0, min(step, height(total) - level))


def _subtrees(base: DataFrame, step: int, *more: str) -> DataFrame:
    """The nodes of each aligned subtree of 2 ** step nodes, in order."""
    nodes = F.struct("at", "digest", *more)
    block = F.expr(f"shiftright(at, {step})").alias("block")
    return base.groupBy("tree", "total", block).agg(F.sort_array(F.collect_list(nodes)).alias("nodes"))


def raised(staging: Staging, base: DataFrame, level: int, step: int) -> DataFrame:
    """The stored level ``step`` above ``base``; a finished tree keeps its top."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for total, nodes in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                digests = nodes.values.field("digest").to_pylist()
                tops.append(upwards(digests, _levels_from(level, step, total))[-1][0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(tops, pa.binary())], names=["tree", "total", "at", "digest"]
            )

    made = _subtrees(base, step).mapInArrow(work, "tree long, total long, at long, digest binary")
    return staging(made, "merkle-level")


def build(staging: Staging, leaves: DataFrame, step: int = STEP) -> list[DataFrame]:
    """Stored levels 0, step, 2 * step, .. of all trees (tree, total, at, digest).

    The last one has one row per tree, its root. No leaves give one empty level.
    """
    most = leaves.agg(F.max("total")).first()[0] or 1
    levels = [leaves]
    for level in range(0, height(most), step):
        levels.append(raised(staging, levels[-1].select("tree", "total", "at", "digest"), level, step))
    return levels


def _siblings(lowest: list[bytes], level: int, step: int, total: int) -> list[bytes]:
    """Per lowest node of a subtree, the siblings on its way up through the subtree."""
    above = upwards(lowest, _levels_from(level, step, total))
    out = []
    for i in range(len(lowest)):
        way = []
        for nodes in above[:-1]:
            if (i ^ 1) < len(nodes):
                way.append(nodes[i ^ 1])
            i >>= 1
        out.append(b"".join(way))
    return out


def lowered(paths: DataFrame, base: DataFrame, level: int, step: int) -> DataFrame:
    """(tree, at, path, carried columns) of the nodes of a stored level, from the
    ``paths`` of the stored level above: the siblings up to the root, lowest first."""
    carried = [c for c in paths.columns if c not in ("tree", "at", "path")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (total, above) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                nodes = batch.column(3)[k].values
                own = _siblings(nodes.field("digest").to_pylist(), level, step, total)
                same = pa.array(np.full(len(own), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(same),
                        nodes.field("at"),
                        pa.array([way + above for way in own], pa.binary()),
                        *[batch.column(c).take(same) for c in range(5, 5 + len(carried))],
                    ],
                    names=["tree", "at", "path", *carried],
                )

    blocks = _subtrees(base, step).join(paths.withColumnRenamed("at", "block"), ["tree", "block"])
    blocks = blocks.select("tree", "total", "block", "nodes", "path", *carried)
    return blocks.mapInArrow(work, paths.select("tree", "at", "path", *carried).schema)


def descended(staging: Staging, levels: list[DataFrame], tops: DataFrame, step: int, last: int) -> DataFrame:
    """The paths of the nodes of stored level ``last``, from those of the trees' roots.

    Each level's paths are stored for the next one and replaced by it.
    """
    paths = tops
    for n in range(len(levels) - 2, last - 1, -1):
        below = staging(lowered(paths, levels[n], n * step, step), "merkle-paths")
        staging.drop(paths)
        paths = below
    return paths


def folded(digest: bytes, path: bytes, place: int, total: int) -> tuple[bytes, int]:
    """The root of a tree from one leaf and its siblings, and the bytes read of them."""
    used = 0
    while total > 1:
        if place ^ 1 < total:
            other = path[used : used + DIGEST]
            used += DIGEST
            digest = digest_of(other, digest) if place & 1 else digest_of(digest, other)
        else:
            digest = digest_of(digest)
        place, total = place >> 1, (total + 1) >> 1
    return digest, used


RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _proofs(step: int, trees: int):
    """Per subtree of leaves: rows with their proof and the root folded from it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            numbers, totals, _, found, aboves, subroots, roots = batch.columns
            for k, (tree, total, above) in enumerate(
                zip(numbers.to_pylist(), totals.to_pylist(), aboves.to_pylist(), strict=True)
            ):
                nodes = found[k].values
                digests = nodes.field("digest").to_pylist()
                root, subroot = roots[k].as_py(), subroots[k].as_py().hex()
                own = _siblings(digests, 0, step, total)
                for place, digest, changed, doc_id, way in zip(
                    nodes.field("at").to_pylist(), digests, nodes.field("tampered").to_pylist(),
                    nodes.field("doc_id").to_pylist(), own, strict=True,
                ):
                    path = way + above
                    top, used = folded(digest if changed is None else changed, path, place, total)
                    top, _ = folded(top, path[used:], tree, trees)
                    rows.append((doc_id, digest.hex(), subroot, root.hex(), digest_of(path).hex(), top.hex(), top == root))
                if len(rows) >= ROWS:
                    yield _result(rows)
                    rows = []
        if rows:
            yield _result(rows)

    return work


def _result(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang_key, doc_id, digest, tampered, salt): ``tampered`` is the leaf of the
    row with 1 added to its n_chars, where it is to be tampered with, else null."""
    changed = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(TAMPERED)) == 0
    return docs.select(
        # Never null, and in the order of the languages: null first, then bytewise.
        F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("")).alias("lang_key"),
        docs["doc_id"].cast("long").alias("doc_id"),
        leaf(docs, docs["n_chars"].cast("long")).alias("digest"),
        F.when(changed, leaf(docs, docs["n_chars"].cast("long") + 1)).alias("tampered"),
        F.rand(13).alias("salt"),
    )


def manifest(spark: SparkSession, docs: DataFrame, step: int = STEP) -> DataFrame:
    """A leaf, its proof and the check of the proof for every row of ``docs``.

    Rows with a null id come first in their language, ties of an id in the order
    of their leaves; equal rows are leaves of their own, and a null language is a
    tree of its own. A row without an id is not tampered with. Columns beyond the
    five of a leaf are not read. An empty table gives no rows. ``step`` says how
    many levels lie between two stored ones and does not change the result.
    """
    prepare(spark)
    staging = Staging(spark)
    cut = staging(leaves(docs), "merkle-leaves")
    at = placed(staging, cut, "lang_key", [F.col(c) for c in ("doc_id", "digest", "salt")], "merkle")
    staging.drop(cut)
    langs = at.select("lang_key", "total").distinct().withColumn("whole", F.lit(0))
    langs = placed(staging, langs.withColumnRenamed("total", "leaves"), "whole", [F.col("lang_key")], "merkle-langs")
    trees = langs.count()
    names = langs.select("lang_key", F.col("at").alias("tree"))
    rows = staging(
        at.join(broadcast_if_small(names), "lang_key").select("tree", "total", "at", "digest", "tampered", "doc_id"), "merkle-rows"
    )
    staging.drop(at)
    levels = build(staging, rows, step)
    subroots = levels[-1].select(F.col("tree").alias("at"), F.col("digest"))
    subroots = staging(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("total"), "at", "digest"),
        "merkle-subroots",
    )
    above = build(staging, subroots, step)
    # One row, the root of all; no rows without documents.
    top = above[-1].select("tree", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("path"), F.col("digest").alias("root"))
    ways = descended(staging, above, staging(top, "merkle-top"), step, 0)
    tops = subroots.select("at", F.col("digest").alias("subroot")).join(ways, "at").select(
        F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "path", "subroot", "root"
    )
    paths = descended(staging, levels, staging(tops, "merkle-tops"), step, 1)
    blocks = _subtrees(rows, step, "tampered", "doc_id").join(paths.withColumnRenamed("at", "block"), ["tree", "block"])
    blocks = blocks.select("tree", "total", "block", "nodes", "path", "subroot", "root")
    return blocks.mapInArrow(_proofs(step, trees), RESULT)
