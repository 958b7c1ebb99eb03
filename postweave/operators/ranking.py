"""Exact row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of the hash used to split a group: 16**4 slices.
SLICE_DIGITS = 4


def _keyed(df: DataFrame, key: str, seed: str) -> DataFrame:
    keyed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))))
    return keyed.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))


def slice_starts(
    df: DataFrame, groups: Sequence[str], key: str, seed: str = "", total: str = "group_rows"
) -> DataFrame:
    """(groups.., _slice, _start, total): rows of a group before each of its slices.

    At most 16**4 rows per group.
    """
    counts = _keyed(df.select(*groups, key), key, seed).groupBy(*groups, "_slice")
    slices = counts.agg(F.count(F.lit(1)).alias("_rows"))
    before = (
        Window.partitionBy(*groups)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return slices.select(
        *groups,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*groups)).alias(total),
    )


def rank_in_slices(
    df: DataFrame,
    starts: DataFrame,
    groups: Sequence[str],
    key: str,
    seed: str = "",
    rank: str = "rank",
) -> DataFrame:
    """Number the rows of the slices in ``starts``; rows of other slices are dropped."""
    inside = Window.partitionBy(*groups, "_slice").orderBy("_hash", key)
    placed = _keyed(df, key, seed).join(starts, [*groups, "_slice"])
    return placed.withColumn(
        rank, (F.col("_start") + F.row_number().over(inside)).cast("long")
    ).drop("_hash", "_slice", "_start")


def hash_rank(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    seed: str = "",
    rank: str = "rank",
    total: str = "group_rows",
) -> DataFrame:
    """Add the 1-based position of each row in its group, in md5 order of ``key``.

    Equal to ``row_number() over (partition by groups order by md5(key||seed), key)``
    but a group is cut into slices by hash prefix: each slice is numbered on its
    own and shifted by the size of the slices before it, so a group holding most
    of the rows still spreads over all tasks. ``total`` is the group's size.
    """
    groups = list(groups)
    starts = slice_starts(df, groups, key, seed, total)
    return rank_in_slices(df, starts, groups, key, seed, rank)


def tile_of(rank: Column, rows: Column, tiles: int) -> Column:
    """0-based ``ntile`` from a 1-based rank and the group size, by arithmetic."""
    k = F.lit(tiles).cast("long")
    base = F.floor(rows / k)
    extra = rows % k
    wide = extra * (base + 1)
    late = extra + F.floor((rank - 1 - wide) / F.greatest(base, F.lit(1)))
    return F.when(rank <= wide, F.floor((rank - 1) / (base + 1))).otherwise(late).cast("int")


def tile_start(tile: Column, rows: Column, tiles: int) -> Column:
    """Number of ranks before ``tile``."""
    k = F.lit(tiles).cast("long")
    return tile * F.floor(rows / k) + F.least(tile.cast("long"), rows % k)


def tile_rows(tile: Column, rows: Column, tiles: int) -> Column:
    k = F.lit(tiles).cast("long")
    return F.floor(rows / k) + F.when(tile < rows % k, 1).otherwise(0)
