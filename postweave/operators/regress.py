"""Regression coefficients of features on the label, from aggregated Gram matrices.

The rows are read once per step: every task adds up the products of its rows, the
sums of the tasks are added row by row of the matrix, and the driver solves a system
as wide as there are features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest half squared Newton decrement, per row, at which a fit has converged.
CONVERGED = 1e-14


def _design(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(y, x) with x the features and a 1."""
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    return df.select(F.col(f"`{label}`").cast("double").alias("y"), F.array(*cells, F.lit(1.0)).alias("x"))


def _numbers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
    x, y = flat.reshape(batch.num_rows, width), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
    if np.isnan(flat).any() or np.isnan(y).any():
        raise ValueError("a feature or the label is missing: impute first")
    return x, y


def _summed(table: pa.Table) -> pa.Table:
    rows = np.array(table.column("values").to_pylist())
    total = pa.array([rows.sum(0)], pa.list_(pa.float64()))
    return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int64()), "values": total})


def _sums(rows: DataFrame, width: int, products) -> np.ndarray:
    """The sum of ``products`` (x, y), a matrix, over all rows; zeros without rows.

    A task sends one matrix however many rows it has read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = products(*_numbers(batch, width))
                total = found if total is None else total + found
        if total is not None:
            lists = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), lists], names=["i", "values"])

    schema = "i long, values array<double>"
    found = rows.mapInArrow(work, schema).groupBy("i").applyInArrow(_summed, schema).collect()
    return np.array([r["values"] for r in sorted(found, key=lambda r: r.i)])


def _table(df: DataFrame, columns: list[str], values) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def ols_coefficients(df: DataFrame, columns: list[str], label: str) -> tuple[DataFrame, float]:
    """(feature, coefficient) of least squares with intercept, and R squared.

    One pass for the means and one for the centred products, whatever the number
    of features. Of coefficients that the rows leave open the smallest are taken.
    """
    rows, width = _design(df, columns, label), len(columns) + 1
    first = _sums(rows, width, lambda x, y: np.r_[x.sum(0), y.sum()][None, :])
    if not len(first) or not first[0][width - 1]:
        return _table(df, columns, np.zeros(len(columns))), float("nan")
    n = first[0][width - 1]
    means = np.r_[first[0][: width - 1], first[0][width]] / n

    def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = np.c_[x[:, :-1], y] - means
        return both.T @ both

    gram = _sums(rows, width, products)
    coefficients = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0] if columns else np.zeros(0)
    explained = coefficients @ gram[:-1, -1]
    return _table(df, columns, coefficients), explained / gram[-1, -1] if gram[-1, -1] else float("nan")


def logit_coefficients(
    df: DataFrame, columns: list[str], label: str, cost: float = 1.0
) -> DataFrame:
    """(feature, coefficient) of L2 logistic regression with inverse strength ``cost``.

    The intercept is not penalised. Newton steps, each from one weighted Gram
    matrix; a step that raises the loss is halved. Steps go on until the decrement
    vanishes: the loss is convex, so there is no limit on them.
    """
    rows, width = _design(df, columns, label).persist(), len(columns) + 1
    penalty = np.r_[np.full(len(columns), 1.0 / cost), 0.0]

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = x @ weights
            p = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            loss = (np.logaddexp(0, out) - y * out).sum()
            gram = (x * (p * (1 - p))[:, None]).T @ x
            return np.r_[gram, [x.T @ (p - y)], [np.r_[loss, len(y), np.zeros(width)][:width]]]

        found = _sums(rows, width, products) if width > 1 else np.zeros((0, 0))
        if not len(found):
            return 0.0, np.zeros(width), np.eye(width), 0.0
        loss, n = found[-1][:2]
        return (
            loss + (penalty * weights**2).sum() / 2, found[-2] + penalty * weights,
            found[:-2] + np.diag(penalty), n,
        )

    try:
        weights = np.zeros(width)
        loss, slope, gram, n = at(weights)
        while n:
            step = np.linalg.lstsq(gram, slope, rcond=None)[0]
            if slope @ step / 2 <= CONVERGED * n:
                break
            share = 1.0
            while True:
                tried = at(weights - share * step)
                if tried[0] <= loss or share < 1e-10:
                    break
                share /= 2
            if tried[0] >= loss:
                break
            weights = weights - share * step
            loss, slope, gram, n = tried
    finally:
        rows.unpersist()
    return _table(df, columns, weights[:-1])


def coefficient_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Features in rows, one coefficient column per dataset."""
    stacked = None
    for name, table in tables.items():
        one = table.withColumn("dataset", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy("feature").pivot("dataset", list(tables)).agg(F.first("coefficient"))
