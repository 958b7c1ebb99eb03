"""Date filter, labels and class sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_range(df: DataFrame, col: str, low: str, high: str, check: bool = True) -> DataFrame:
    """Keep rows between two dates, both ends inclusive, the upper at midnight."""
    if not check:
        return df
    kind = df.schema[col].dataType.typeName()
    kind = kind if kind.startswith(("timestamp", "date")) else "timestamp_ntz"
    return df.filter(F.col(col).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def date_bounds(df: DataFrame, col: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(col).alias("min_date"), F.max(col).alias("max_date"), F.count(F.lit(1)).alias("rows")
    )


def positive(col: Column) -> Column:
    """True where the count is above zero; a missing count is False."""
    return F.coalesce(col > 0, F.lit(False))


def label_table(df: DataFrame, id_col: str, label_col: str, kind: str = "boolean") -> DataFrame:
    """(id, label): a boolean from a counter, or an existing class column as it is."""
    label = positive(F.col(label_col)) if kind == "boolean" else F.col(label_col)
    return df.select(id_col, label.alias("label"))


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def distinct_labels(labels: DataFrame) -> DataFrame:
    return labels.select("label").distinct()
