"""Balanced sampling and nested stratified folds from one ranking per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.operators.ranking import (
    rank_in_slices,
    slice_starts,
    tile_of,
    tile_rows,
    tile_start,
)
from postweave.session import broadcast_if_small, stage


def balanced_sample(labels: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Cut every class to the size of the smallest one: (id, label, rank, class_rows).

    The draw is the first rows of each class in seeded md5 order, so it is
    repeatable and needs no random state on the executors. Slices of that order
    lying beyond the cut are dropped as they are read; only the sample and the
    slice at the cut are shuffled.
    """
    rows, seed_text = labels.select(id_col, "label"), f":{seed}"
    starts = stage(slice_starts(rows, ["label"], id_col, seed_text), "slices")
    smallest = starts.agg(F.min("group_rows")).first()[0] or 0
    needed = broadcast_if_small(starts.filter(F.col("_start") < smallest).drop("group_rows"))
    ranked = rank_in_slices(rows, needed, ["label"], id_col, seed_text)
    sample = ranked.filter(F.col("rank") <= smallest)
    return sample.select(
        id_col, "label", "rank", F.lit(smallest).cast("long").alias("class_rows")
    )


def nested_folds(sample: DataFrame, outer: int, inner: int, only: int | None = None) -> DataFrame:
    """Long fold table (.., outer_fold, inner_fold), one row per post and outer fold.

    ``inner_fold`` is NULL for the outer test part. Outer folds are blocks of
    consecutive ranks in a class, so a post's place among the training rows of
    any outer fold follows by arithmetic: no further shuffle after the ranking.
    ``only`` restricts the table to one outer fold.
    """
    rank, rows = F.col("rank"), F.col("class_rows")
    fold = F.col("outer_fold")
    choices = [only] if only is not None else list(range(outer))
    long = sample.withColumn("outer_fold", F.explode(F.array(*[F.lit(o) for o in choices])))
    start = tile_start(fold, rows, outer)
    size = tile_rows(fold, rows, outer)
    held_out = tile_of(rank, rows, outer) == fold
    place = F.when(rank <= start, rank).otherwise(rank - size)
    return long.withColumn(
        "inner_fold",
        F.when(~held_out, tile_of(place, rows - size, inner)),
    ).drop("rank", "class_rows")


def write_folds(folds: DataFrame, path: str) -> DataFrame:
    """The fold table stored by (outer_fold, inner_fold), and read back.

    The test part of an outer fold is the partition without an inner fold. Reading
    the parts of one fold opens its folders alone.
    """
    folds.write.mode("overwrite").partitionBy("outer_fold", "inner_fold").parquet(path)
    return folds.sparkSession.read.schema(folds.schema).parquet(path).select(folds.columns)


def split_ids(folds: DataFrame, outer: int, cv: int | str) -> tuple[DataFrame, DataFrame]:
    """Training and validation ids of one fold; ``cv='all'`` trains on every inner
    fold and validates on the outer test part."""
    part = folds.filter(F.col("outer_fold") == outer).drop("outer_fold")
    inner = F.col("inner_fold")
    if cv == "all":
        train, valid = part.filter(inner.isNotNull()), part.filter(inner.isNull())
    else:
        train = part.filter(inner.isNotNull() & (inner != cv))
        valid = part.filter(inner == cv)
    return train.drop("inner_fold"), valid.drop("inner_fold")


def sampled_ids(folds: DataFrame, outer: int, id_col: str) -> DataFrame:
    """Every sampled id: the inner folds of one outer fold plus its test part."""
    return folds.filter(F.col("outer_fold") == outer).select(id_col)


def restrict(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` for the given ids, keeping ids without a row (right join)."""
    return df.join(ids, id_col, "right")
