"""Topic features: fit on training posts, infer for all, describe."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.operators import gibbs
from postweave.operators.dictionary import build_dictionary, vocabulary
from postweave.operators.in_row import portions


@dataclass(frozen=True)
class TopicModel:
    """Counts by word and topic, the topics' prior, the log-likelihood per word of each
    pass, and the stored blocks of training posts with their last topics."""

    terms: list[str]
    topics: int
    counts: np.ndarray | None = None
    alpha: np.ndarray | None = None
    fits: tuple[float, ...] = ()
    blocks: DataFrame | None = None

    def shares(self) -> np.ndarray:
        """Share of each word (row) in each topic (column)."""
        raised = self.counts + gibbs.BETA
        return raised / raised.sum(0)


def fit_topics(
    train: DataFrame,
    topics: int,
    no_below: int = 1,
    no_above: float = 1,
    iterations: int | None = None,
    seed: int = 0,
    gain: float = gibbs.GAIN,
    terms_col: str = "final_text",
) -> TopicModel:
    """Dictionary and topic model of the training posts, by Gibbs sampling.

    Each pass reads all posts and merges one words x topics table, whose size the
    dictionary bounds. Without ``iterations`` the passes end when five of them gain less
    than ``gain`` in log-likelihood per word. Without a dictionary term there is no model
    and weights are 0.
    """
    terms = vocabulary(build_dictionary(train, no_below, no_above, terms_col))
    if not terms:
        return TopicModel(terms, topics)
    counts, alpha, fits, blocks = gibbs.fit_counts(
        train, terms, topics, seed, terms_col, iterations, gain
    )
    return TopicModel(terms, topics, counts, alpha, tuple(fits), blocks)


def topic_terms(fitted: TopicModel) -> DataFrame:
    """(term, topic, n): how many of a term's occurrences lie in each topic, from 1."""
    spark = fitted.blocks.sparkSession
    names = spark.createDataFrame(
        pa.table({"place": pa.array(range(len(fitted.terms)), pa.int64()), "term": fitted.terms})
    )
    cells = gibbs.merged(fitted.blocks).filter("cell >= 0").select(
        F.floor(F.col("cell") / fitted.topics).alias("place"),
        (F.col("cell") % fitted.topics + 1).cast("int").alias("topic"),
        F.col("n").cast("long").alias("n"),
    )
    return cells.join(names, "place").select("term", "topic", "n")


def clean_weights(weights: Column, cutoff: float) -> Column:
    """Weights up to the cutoff become 0; the rest is divided by its sum unless 0."""
    kept = F.transform(weights, lambda w: F.when(w > cutoff, w).otherwise(F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, w: acc + w)
    return F.when(total == 0, kept).otherwise(F.transform(kept, lambda w: w / total))


def infer_topics(
    df: DataFrame, fitted: TopicModel, terms_col: str = "final_text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (all if not given) with ``topic_weights`` (raw) per post; all zero
    without any known term."""
    keep = list(df.columns if keep is None else keep)
    if fitted.counts is None:
        return df.select(*[F.col(f"`{c}`") for c in keep]).withColumn("topic_weights", F.array_repeat(F.lit(0.0), fitted.topics))
    shared = df.sparkSession.sparkContext.broadcast(
        (pa.array(fitted.terms), fitted.shares(), fitted.alpha)
    )
    at = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, shares, alpha = shared.value
        for batch in (part for whole in batches for part in portions(whole, at)):
            words = gibbs.post_words(batch.column(at), terms)
            found = gibbs.post_shares(*words, shares, alpha)
            ends = pa.array(np.arange(len(found) + 1) * len(alpha), pa.int32())
            weights = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], weights], names=[*keep, "topic_weights"]
            )

    weights = T.StructField("topic_weights", T.ArrayType(T.DoubleType()))
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(terms_col).alias("_terms"))
    return given.mapInArrow(work, T.StructType([*given.schema.fields[:at], weights]))


def topic_keywords(spark: SparkSession, fitted: TopicModel, words: int = 10) -> DataFrame:
    """(topic, keywords), topics from 1; one row per topic, so its size is bounded."""
    rows = []
    if fitted.counts is not None:
        shares = fitted.shares()
        for k in range(fitted.topics):
            # Ties in the order of the dictionary.
            best = np.argsort(-shares[:, k], kind="stable")[:words]
            rows.append((k + 1, ", ".join(fitted.terms[i] for i in best)))
    return spark.createDataFrame(rows, "topic int, keywords string")


def dominant(weights: Column) -> tuple[Column, Column]:
    """(0-based position, weight rounded half-even to 4 digits) of the first maximum."""
    top = F.array_max(weights)
    return (
        (F.array_position(weights, top) - 1).cast("int"),
        F.bround(top.cast("double"), 4),
    )


def top_per_group(df: DataFrame, group: str, by: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest value per group.

    Every task keeps its own best ``n`` per group before the shuffle, so a group
    of any size costs a task no more than ``n`` rows per input partition.
    """
    order = Window.partitionBy(group).orderBy(F.desc(by), id_col)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def dominant_topics(
    inferred: DataFrame, keywords: DataFrame
) -> DataFrame:
    """Training posts with their dominant topic, its weight and its keywords."""
    position, weight = dominant(F.col("topic_weights"))
    placed = inferred.withColumns(
        {"dominant_topic": position, "contribution": weight}
    ).drop("topic_weights")
    named = keywords.select((F.col("topic") - 1).alias("dominant_topic"), "keywords")
    # One row per topic: bounded by the number of topics.
    return placed.join(F.broadcast(named), "dominant_topic")
