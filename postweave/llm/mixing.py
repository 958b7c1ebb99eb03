"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

A source with rate r gives each of its documents a number of copies drawn from
a Poisson distribution with mean r. The draw inverts the distribution at a
uniform number hashed from the document's id and a seed, so it can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import Staging

SEED = 7
# Rates above this are drawn as sums of equal parts: exp(-rate) must not vanish.
PART = 500.0
# Sources up to which their table of rates is broadcast, once counted.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """Number in (0, 1) from the first 52 bits of the MD5 of the joined parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def poisson(u: Column, rate: Column) -> Column:
    """Smallest k whose Poisson probability of at most k is above ``u``.

    The terms go on until no uniform of 52 bits can lie beyond them.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.exp(-rate)
    step = F.struct(start.alias("p"), start.alias("c"), F.lit(0).alias("n"))

    def next_term(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(
            p.alias("p"),
            (acc["c"] + p).alias("c"),
            F.when(acc["c"] <= u, k).otherwise(acc["n"]).alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), step, next_term, lambda acc: acc["n"])


def source_rates(
    spark: SparkSession,
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
) -> DataFrame:
    """(source, rate) of all sources, null among them; a stored table.

    The target of a source is its share of ``epochs`` times all bytes; a byte
    more per document stands for its separator. Without ``weights`` a source's
    weight is the square root of its bytes. A source that ``weights`` does not
    name has weight 0.
    """
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    sizes = docs.select("source", size.alias("size")).groupBy("source").agg(
        F.sum("size").cast("double").alias("bytes")
    )
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt("bytes"))
    else:
        pairs = [p for k, w in weights.items() for p in (F.lit(k), F.lit(float(w)))]
        given = F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0.0)
        sizes = sizes.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    sizes = Staging(spark)(sizes, "source-sizes")
    # One row, whatever the input.
    whole = sizes.agg(F.sum("weight").alias("weights"), F.sum("bytes").alias("total")).first()
    scale = epochs * whole["total"] / whole["weights"] if whole["weights"] else 0.0
    return sizes.select("source", (F.col("weight") * scale / F.col("bytes")).alias("rate"))


def replicate(
    spark: SparkSession,
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = SEED,
    keep: bool = False,
) -> DataFrame:
    """Copies of ``docs`` in global random order: doc_id, source, copy, shuffle_key.

    ``copy`` counts from 0. With ``keep`` the result has the struct ``row`` of
    all columns as well. Rows with an equal id draw the same number; rows without
    one draw by the hash of the row, so only equal ones draw the same. Empty texts
    count as one byte. An empty table gives no rows. Rows are dealt out by the
    hash of the key and sorted by it within a partition, so documents and copies
    of a source lie anywhere.
    """
    rates = source_rates(spark, docs, weights, epochs)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("source").alias("rated"), "rate")
    whole = F.struct(*[docs[c] for c in docs.columns])
    own = F.when(docs["doc_id"].isNull(), F.concat(F.lit("null:"), F.xxhash64(whole))).otherwise(
        docs["doc_id"].cast("string")
    )
    rows = docs.select(
        docs["doc_id"], docs["source"], own.alias("own"), *([whole.alias("row")] if keep else [])
    )
    joined = rows.join(
        F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("rated"))
    )
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    drawn = F.transform(
        F.sequence(F.lit(1), parts),
        lambda j: poisson(
            uniform(F.col("own"), F.lit(seed), j), F.col("rate") / parts
        ),
    )
    n = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    copies = joined.withColumn("copies", n).filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    key = F.conv(
        F.substring(F.md5(F.concat_ws(":", "own", "copy", F.lit(f"{seed}-order"))), 1, 15), 16, 10,
    ).cast("long")
    out = copies.withColumn("shuffle_key", key)
    columns = ["doc_id", "source", F.col("copy").cast("int").alias("copy"), "shuffle_key"]
    return (
        out.select(*columns, *(["row"] if keep else []))
        .repartition(F.col("shuffle_key"))
        .sortWithinPartitions("shuffle_key", "doc_id", "copy")
    )
