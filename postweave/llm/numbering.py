"""Places of rows in a global order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.common import Staging
from postweave.session import broadcast_if_small


def placed(staging: Staging, rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with ``at``, their place in the order of their group from 0, and ``total``.

    Rows are dealt out by ranges of (group, order), so a group of any size is cut
    into ranges; a place is the one in the range, shifted by the rows before it.
    ``group`` must not be null. Equal rows are in any order, one after another: to
    split many of them, ``order`` may end with any stored number. Stored twice, the
    second time with places.
    """
    keys = [F.col(group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = staging(dealt.withColumn("_line", F.monotonically_increasing_id()), f"{name}-ordered")
    part = F.shiftright("_line", 33)
    parts = dealt.groupBy(part.alias("_part"), group).agg(
        F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # As many rows per group as there are ranges.
    own = Window.partitionBy(group)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staging(
        parts.select(
            "_part", group, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
            F.sum("_rows").over(own).alias("total"),
        ),
        f"{name}-ranges",
    )
    found = dealt.withColumn("_part", part).join(broadcast_if_small(parts), ["_part", group]).withColumn(
        "at", F.col("_start") + F.col("_line") - F.col("_first")
    )
    found = staging(found.drop("_part", "_line", "_first", "_start", "_rows"), f"{name}-placed")
    staging.drop(dealt)
    staging.drop(parts)
    return found
