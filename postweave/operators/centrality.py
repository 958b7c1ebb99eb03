"""Betweenness centrality by joins keyed on (source, tag)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.operators.tag_graph import both_ways, vertices
from postweave.session import stage, stage_until

# (source, tag) pairs kept at a time; more sources run in further batches.
STATE_ROWS = 2_000_000_000


def _distances(sym: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, d): shortest distance from every source to every reached tag."""
    own = F.lit(0).cast("long").alias("d")
    known = stage(sources.select("s", F.col("s").alias("v"), own), "dist")
    front = known
    while True:
        tried = (
            front.join(sym, front.v == sym.a)
            .select("s", F.col("b").alias("v"), (F.col("d") + F.col("weight")).alias("new"))
            .groupBy("s", "v")
            .agg(F.min("new").alias("new"))
        )
        merged = known.join(tried, ["s", "v"], "full")
        closer = F.col("d").isNull() | (F.col("new") < F.col("d"))
        step = merged.select(
            "s",
            "v",
            F.least("d", "new").alias("d"),
            F.coalesce(closer & F.col("new").isNotNull(), F.lit(False)).alias("moved"),
        )
        step, settled = stage_until(step, "dist", F.col("moved"))
        known = step.select("s", "v", "d")
        if settled:
            return known
        front = step.filter("moved").select("s", "v", "d")


def _path_edges(sym: DataFrame, dist: DataFrame) -> DataFrame:
    """(s, u, v): edges lying on a shortest path from s."""
    near = dist.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    step = near.join(sym, near.u == sym.a).select(
        "s", "u", F.col("b").alias("v"), (F.col("du") + F.col("weight")).alias("d")
    )
    return step.join(dist, ["s", "v", "d"]).select("s", "u", "v")


def _hop_sums(start: DataFrame, edges: DataFrame, step, name: str) -> DataFrame:
    """Sum of x over all hops of x' = step(x, edges), the start included."""
    parts = [stage(start, name)]
    while True:
        following, empty = stage_until(step(parts[-1], edges), name, F.lit(True))
        if empty:
            break
        parts.append(following)
    both = reduce(DataFrame.unionByName, parts)
    return stage(both.groupBy("s", "v").agg(F.sum("x").alias("x")), name)


def _forward(x: DataFrame, edges: DataFrame) -> DataFrame:
    moved = x.withColumnRenamed("v", "u").join(edges, ["s", "u"])
    return moved.groupBy("s", "v").agg(F.sum("x").alias("x"))


def _backward(x: DataFrame, edges: DataFrame) -> DataFrame:
    moved = x.join(edges, ["s", "v"])
    return moved.groupBy("s", F.col("u").alias("v")).agg(
        F.sum(F.col("x") * F.col("ratio")).alias("x")
    )


def _dependencies(sym: DataFrame, sources: DataFrame) -> DataFrame:
    """(tag, part): dependency of the given sources on every tag."""
    dist = _distances(sym, sources)
    edges = stage(_path_edges(sym, dist), "paths")
    one = F.lit(1.0).alias("x")
    sigma = _hop_sums(sources.select("s", F.col("s").alias("v"), one), edges, _forward, "sigma")
    from_u = sigma.select("s", F.col("v").alias("u"), F.col("x").alias("xu"))
    rated = (
        edges.join(from_u, ["s", "u"])
        .join(sigma, ["s", "v"])
        .select("s", "u", "v", (F.col("xu") / F.col("x")).alias("ratio"))
    )
    rated = stage(rated, "paths")
    ends = dist.filter(F.col("s") != F.col("v")).select("s", "v", one)
    pushed = _hop_sums(ends, rated, _backward, "push")
    # The start value 1 of every reached tag is not a dependency.
    gained = pushed.filter(F.col("s") != F.col("v"))
    return gained.groupBy(F.col("v").alias("tag")).agg(F.sum(F.col("x") - 1).alias("part"))


def betweenness(
    edges: DataFrame, weighted: bool = False, state_rows: int = STATE_ROWS
) -> DataFrame:
    """(tag, centrality), normalised by (n-1)(n-2) over both directions.

    In the weighted graph the co-occurrence count is the length of an edge.
    Sources are handled in batches so that at most about ``state_rows`` pairs
    of source and tag are held at once; batch results are added up.
    """
    sym = both_ways(edges)
    if not weighted:
        sym = sym.withColumn("weight", F.lit(1).cast("long"))
    sym = stage(sym, "graph")
    nodes = stage(vertices(edges).select(F.col("tag").alias("s")), "sources")
    n = nodes.count()
    batches = max(1, -(-n * n // state_rows))
    parts = []
    for batch in range(batches):
        mine = nodes
        if batches > 1:
            mine = nodes.filter(F.pmod(F.xxhash64("s"), F.lit(batches)) == batch)
        parts.append(stage(_dependencies(sym, mine), "between"))
    total = reduce(DataFrame.unionByName, parts).groupBy("tag").agg(F.sum("part").alias("part"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return (
        nodes.withColumnRenamed("s", "tag")
        .join(total, "tag", "left")
        .select("tag", (F.coalesce("part", F.lit(0.0)) * scale).alias("centrality"))
    )
