"""Tag co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import tag_set

# Longest tag set paired up in one piece; longer sets are cut into blocks.
BLOCK = 256


def _pairs(sets: DataFrame) -> DataFrame:
    """(src, dst, posts) of sorted tag sets, one row per unordered pair."""
    # A tag set is never empty; the outer form spares a filter that would parse it again.
    first = sets.select(
        "posts", F.posexplode_outer("tags").alias("place", "src"), "tags"
    )
    rest = F.slice(F.col("tags"), F.col("place") + 2, F.lit(BLOCK))
    return first.select("src", F.explode(rest).alias("dst"), "posts")


def _block_pairs(sets: DataFrame) -> DataFrame:
    """The same for sets of any length: pairs of blocks are spread over tasks."""
    last = F.floor((F.size("tags") - 1) / BLOCK).cast("int")
    lefts = sets.select("posts", "tags", F.explode_outer(F.sequence(F.lit(0), last)).alias("i"))
    last = F.floor((F.size("tags") - 1) / BLOCK).cast("int")
    both = lefts.select(
        "posts", "tags", "i", F.explode_outer(F.sequence(F.col("i"), last)).alias("j")
    )

    def block(n: str):
        return F.slice(F.col("tags"), F.col(n) * BLOCK + 1, F.lit(BLOCK))

    cut = both.select("posts", block("i").alias("left"), block("j").alias("right"))
    spread = cut.repartition("left", "right")
    src = spread.select("posts", "right", F.explode_outer("left").alias("src"))
    dst = src.select("src", "posts", F.explode_outer("right").alias("dst"))
    return dst.filter(F.col("src") < F.col("dst")).select("src", "dst", "posts")


def cooccurrence_edges(df: DataFrame, tags_col: str, weighted: bool = True) -> DataFrame:
    """Undirected edges (src, dst, weight), src < dst; weight is the number of posts
    holding both tags, or 1 in the unweighted graph.

    Posts with the same tag set are counted first and paired once, so copies
    cost nothing; pair counts combine before the shuffle.
    """
    sets = (
        df.select(tag_set(F.col(tags_col)).alias("tags"))
        .groupBy("tags")
        # The size is aggregated so that both branches below share one shuffle.
        .agg(F.count(F.lit(1)).alias("posts"), F.max(F.size("tags")).alias("n_tags"))
    )
    short = _pairs(sets.filter(F.col("n_tags") <= BLOCK))
    pairs = short.unionByName(_block_pairs(sets.filter(F.col("n_tags") > BLOCK)))
    if weighted:
        return pairs.groupBy("src", "dst").agg(F.sum("posts").alias("weight"))
    return pairs.select("src", "dst").distinct().withColumn("weight", F.lit(1).cast("long"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with every edge in both directions."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(turned).toDF("a", "b", "weight")


def vertices(edges: DataFrame) -> DataFrame:
    """Endpoints of edges; tags never paired are not in the graph."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("tag"))
    return ends.distinct()
