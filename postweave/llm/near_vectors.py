"""Near-duplicate vectors by one navigable graph per shard.

Equal vectors of a label are one class. Classes are dealt into shards of a
bounded size, each with a graph of its own; the classes of every shard are
searched in the graphs of all shards of their label. Beams widen until an audit
against all vectors of the shard passes, every match is verified by its cosine
in double precision, and what is linked is joined to components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import Staging, components, prepare
from postweave.llm.hnsw import Graph, unit

LEAST = 0.98
# Classes of a shard on average, and shards whose classes are searched in one task.
SHARD = 8192
BLOCK = 8
BEAM = 64
AUDIT = 256
RECALL = 0.995
# Slack of single precision in the search, undone by the verification.
SLACK = 1e-4
GRAPHS = (
    "label string, dim int, shard long, ids binary, weights binary, vectors binary, "
    "links binary, widths binary, entry long"
)
FOUND = "node long, links long, root long, beam long, recall double"


def usable(vector: Column) -> Column:
    """Neither null nor empty or zero, and all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, node, n): distinct usable vectors per label.

    node is the smallest vec_id of the class and n its number of rows.
    """
    return (
        vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
        .filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").cast("long").alias("node"), F.count(F.lit(1)).alias("n"))
    )


def _build(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("node").to_numpy())
    table = table.take(pa.array(order))
    dim = table.column("dim")[0].as_py()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = unit(flat.astype(np.float64).reshape(-1, dim))
    mixed = np.random.default_rng(0).permutation(len(vectors))  # neighbours may have near ids
    graph = Graph.build(vectors[mixed])
    links = np.hstack(graph.layers)
    widths = np.array([layer.shape[1] for layer in graph.layers], np.int64)
    column = lambda name: table.column(name).to_numpy()[mixed].astype(np.int64).tobytes()
    values = [
        table.column("label")[0].as_py(), dim, table.column("shard")[0].as_py(), column("node"),
        column("n"), vectors[mixed].tobytes(), links.tobytes(), widths.tobytes(), graph.entry,
    ]
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64()]
    names = ["label", "dim", "shard", "ids", "weights", "vectors", "links", "widths", "entry"]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    weights = np.frombuffer(row["weights"], np.int64)
    return ids, weights, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)


def _searched(least: float, beam: int, audit: int, recall: float):
    def work(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        out = []
        for place in range(graphs.num_rows):
            row = {c: graphs.column(c)[place].as_py() for c in graphs.column_names}
            ids, weights, vectors = _loaded(row)
            widths = np.frombuffer(row["widths"], np.int64)
            links = np.frombuffer(row["links"], np.int32).reshape(len(ids), -1)
            layers = np.split(links, np.cumsum(widths)[:-1], axis=1)
            graph = Graph(vectors.astype(np.float32), layers, row["entry"])
            for k in range(queries.num_rows):
                asked = {c: queries.column(c)[k].as_py() for c in ("from_shard", "ids", "weights", "vectors")}
                own_ids, _, own = _loaded(asked)
                same = np.arange(len(ids)) if asked["from_shard"] == row["shard"] else None
                at, node, used, share = graph.audited(own, least - SLACK, beam, recall, audit, same)
                true = np.einsum("ij,ij->i", own[at], vectors[node]) >= least
                true &= own_ids[at] != ids[node]
                out.append(_summed(own_ids, ids, weights, at[true], node[true], used, share))
        return pa.concat_tables(out) if out else _table([], [], [], 0, 1.0)

    return work


def _summed(own_ids, ids, weights, at, node, beam, recall) -> pa.Table:
    """Links per query, and a star of each group that these links join."""
    links = np.bincount(at, weights[node], len(own_ids)).astype(np.int64)
    # Smallest id of the group on both sides, by rounds of minima over the links.
    left, right = own_ids.copy(), ids.copy()
    while len(at):
        low = np.minimum(left[at], right[node])
        before = left.sum() + right.sum()
        np.minimum.at(left, at, low)
        np.minimum.at(right, node, low)
        if left.sum() + right.sum() == before:
            break
    linked = np.flatnonzero(links)
    met = np.unique(node)
    nodes = np.concatenate([own_ids[linked], ids[met]])
    counts = np.concatenate([links[linked], np.zeros(len(met), np.int64)])
    return _table(nodes, counts, np.concatenate([left[linked], right[met]]), beam, recall)


def _table(nodes, counts, roots, beam: int, recall: float) -> pa.Table:
    n = len(nodes)
    arrays = [
        pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(roots, pa.int64()),
        pa.array([beam] * n, pa.int64()), pa.array([recall] * n, pa.float64()),
    ]
    return pa.Table.from_arrays(arrays, ["node", "links", "root", "beam", "recall"])


def graphs(
    spark: SparkSession, distinct: DataFrame, shard: int = SHARD
) -> DataFrame:
    """One row per shard with its graph; ``distinct`` is the stored table of classes.

    A label's shards follow from its number of classes, so no shard grows with
    the table. Vectors of different lengths are in different shards.
    """
    sized = distinct.withColumn("dim", F.size("embedding"))
    shards = sized.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = sized.join(shards, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards"))
    )
    plain = dealt.select(
        "label", "dim", "shard", "node", "n", F.col("embedding").cast("array<double>").alias("embedding")
    )
    return plain.groupBy("label", "dim", "shard").applyInArrow(_build, GRAPHS)


def links(
    spark: SparkSession,
    built: DataFrame,
    least: float = LEAST,
    beam: int = BEAM,
    audit: int = AUDIT,
    recall: float = RECALL,
) -> DataFrame:
    """(node, links, root, beam, recall): what each shard's classes find in each graph.

    ``built`` is stored. A task has one graph and the classes of BLOCK shards.
    """
    last = built.groupBy("label", "dim").agg(F.max("shard").alias("last"))
    with_last = built.join(last, ["label", "dim"])
    asked = with_last.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard"),
        F.floor(F.col("shard") / BLOCK).alias("block"), F.col("shard").alias("from_shard"),
        # New names: the other side comes from the same table.
        *[F.col(c).alias(c) for c in ("label", "dim", "ids", "weights", "vectors")],
    )
    held = with_last.select(
        *built.columns,
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BLOCK))).alias("block"),
    )
    keys = ["label", "dim", "shard", "block"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        _searched(least, beam, audit, recall), FOUND
    )


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, least: float = LEAST, shard: int = SHARD
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Vectors that are null, empty, zero or not finite, and rows without a label or
    an id, link with nothing and are components of their own. Rows with an equal
    vector and label link with each other, repeated ids included. Vectors of
    other lengths have no cosine and do not link. An empty table gives no rows;
    columns other than vec_id, label and embedding are not read.
    """
    prepare(spark)
    staging = Staging(spark)
    distinct = staging(classes(vectors), "vector-classes")
    built = staging(graphs(spark, distinct, shard), "vector-graphs")
    found = staging(links(spark, built, least), "vector-links")
    joined = components(spark, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        distinct.join(counts, "node", "left")
        .join(joined.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
        .select(
            F.col("label").alias("of_label"), F.col("embedding").alias("of_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    out = rows.join(
        placed,
        (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_vector"))
        & F.col("vec_id").isNotNull(),
        "left",
    )
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
