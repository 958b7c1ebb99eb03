"""Paired comparison of prediction sets with McNemar tests."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.functions.mcnemar import chi_square, chi_square_p, exact_p
from postweave.sources.store import write_table


def contingency(
    preds: DataFrame, by: tuple[str, ...] = (), experiment: str = "experiment", id_col: str = "id"
) -> DataFrame:
    """2x2 counts of every ordered pair of experiments, the diagonal included.

    Input (by.., experiment, id, pred, true). Output (by.., a, b, both_right,
    only_b, only_a, both_wrong, same_targets): ``only_a`` is cell [1, 0] of the
    table, ``only_b`` cell [0, 1].

    A post becomes two numbers of one bit per experiment: predicted, and right. A
    task packs its posts into words of bits per experiment and counts the ones of
    each pair of experiments at once, so there is no row per pair and post: k
    experiments on n posts send k x k counts per task. Their targets are compared
    through the classes of each post. The experiments' names reach the driver.
    """
    by = list(by)
    names = sorted(r[0] for r in preds.select(experiment).distinct().collect())
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(experiment)) - 1 if names else F.lit(0)
    outcome = F.struct(
        place.cast("int").alias("at"),
        (F.col("pred") == F.col("true")).alias("right"),
        F.xxhash64(F.col("true").cast("string")).alias("target"),
    )
    posts = preds.groupBy(*by, id_col).agg(F.collect_list(outcome).alias("found"))
    spread = T.StructType([posts.schema[c] for c in by] + [T.StructField(c, T.LongType()) for c in COUNTS])
    counts = posts.select(*by, F.col("found")).mapInArrow(_pair_counts(len(by), len(names)), spread)
    summed = counts.groupBy(*by, "a", "b").agg(*[F.sum(c).alias(c) for c in COUNTS[2:]])
    named = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    sizes = summed.filter("a = b").select(*by, F.col("a").alias("at"), F.col("common").alias("size"))
    of_a = sizes.select(*by, F.col("at").alias("a"), F.col("size").alias("na"))
    of_b = sizes.select(*by, F.col("at").alias("b"), F.col("size").alias("nb"))
    whole = (F.col("common") == F.col("na")) & (F.col("common") == F.col("nb"))
    return summed.filter("common > 0").join(of_a, [*by, "a"]).join(of_b, [*by, "b"]).select(
        *by,
        F.get(named, F.col("a").cast("int")).alias("a"),
        F.get(named, F.col("b").cast("int")).alias("b"),
        "both_right",
        (F.col("right_b") - F.col("both_right")).alias("only_b"),
        (F.col("right_a") - F.col("both_right")).alias("only_a"),
        (F.col("common") - F.col("right_a") - F.col("right_b") + F.col("both_right")).alias("both_wrong"),
        (whole & (F.col("agree") == F.col("common"))).alias("same_targets"),
    )


# Per ordered pair: posts of both, right on both, right on either among them, and
# posts of both with one target.
COUNTS = ("a", "b", "common", "both_right", "right_a", "right_b", "agree")
# Posts that a task packs into bits at a time.
PACKED = 1 << 16


def _common_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ones that row i of ``left`` and row j of ``right`` share, for all i and j."""
    return np.array([np.bitwise_count(row & right).sum(1) for row in left], np.int64).reshape(len(left), len(right))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _count_portion(found: pa.Array, k: int) -> np.ndarray:
    """counts[c][a][b] of ``COUNTS`` from c = 2 on, over some posts."""
    n = len(found)
    lengths = found.value_lengths().to_numpy(zero_copy_only=False)
    flat = found.flatten()
    at, right, target = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "right", "target"))
    post = np.repeat(np.arange(n), lengths)
    there, good = np.zeros((k, n), bool), np.zeros((k, n), bool)
    there[at, post], good[at, post] = True, right.astype(bool)
    seen, won = _words(there), _words(good)
    out = np.stack([
        _common_bits(seen, seen), _common_bits(won, won), _common_bits(won, seen), _common_bits(seen, won),
        np.zeros((k, k), np.int64),
    ])
    # Posts with one target for all agree for all of their pairs; of others each
    # target is a set of bits of its own.
    first = np.zeros(n, np.int64)
    first[post[::-1]] = target[::-1]
    odd = np.zeros(n, bool)
    odd[post[target != first[post]]] = True
    out[4] = _common_bits(_words(there & ~odd), _words(there & ~odd))
    rest = np.flatnonzero(odd[post])
    for value in np.unique(target[rest]):
        own = np.zeros((k, n), bool)
        some = rest[target[rest] == value]
        own[at[some], post[some]] = True
        out[4] += _common_bits(_words(own), _words(own))
    return out


def _pair_counts(keys: int, k: int):
    """Counts of all ordered pairs, per group of the first ``keys`` columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = [c.type for c in batch.columns[:keys]]
            groups = list(zip(*[c.to_pylist() for c in batch.columns[:keys]], strict=True)) if keys else [()] * batch.num_rows
            for group in set(groups):
                at = np.array([i for i, g in enumerate(groups) if g == group])
                for start in range(0, len(at), PACKED):
                    counts = _count_portion(batch.column(keys).take(pa.array(at[start : start + PACKED])), k)
                    totals[group] = totals[group] + counts if group in totals else counts
        a, b = (v.ravel() for v in np.indices((k, k)))
        for group, counts in totals.items():
            same = [pa.array([v] * (k * k), kind) for v, kind in zip(group, kinds, strict=True)]
            cells = [pa.array(v) for v in (a, b, *counts.reshape(len(counts), -1))]
            yield pa.RecordBatch.from_arrays([*same, *cells], names=[*[f"by{i}" for i in range(keys)], *COUNTS])

    return work


def pair_tables(tables: DataFrame) -> DataFrame:
    """Tables of all m-choose-2 pairs with their ``a vs b`` name."""
    return tables.filter("a < b").withColumn(
        "models", F.concat_ws(" vs ", "a", "b")
    )


def mcnemar(tables: DataFrame, corrected: bool = True, exact: bool = False) -> DataFrame:
    """Add ``chi2`` and ``p_value``; both NULL where targets differ."""
    b, c = F.col("only_b"), F.col("only_a")
    if exact:
        chi2, p = F.least(b, c).cast("double"), exact_p(b, c)
    else:
        chi2 = chi_square(b, c, corrected)
        p = chi_square_p(chi2)
    fit = F.col("same_targets")
    return tables.withColumn("chi2", F.when(fit, chi2)).withColumn("p_value", F.when(fit, p))


def p_matrix(tests: DataFrame, experiments: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and columns are experiments, cells p-values, per metric."""
    return (
        tests.groupBy(*by, F.col("a").alias("experiment"))
        .pivot("b", experiments)
        .agg(F.first("p_value"))
    )


def experiment_report(results: dict[str, DataFrame], metric: str) -> DataFrame:
    """Results of one metric, transposed: (field, one text column per experiment).

    Results with different columns are stacked by name; gaps read ``-``.
    """
    stacked = None
    for name, df in results.items():
        one = df.filter(F.col("metric") == metric).select(
            F.lit(name).alias("experiment"), *[F.col(c).cast("string").alias(c) for c in df.columns]
        )
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    fields = [c for c in stacked.columns if c != "experiment"]
    long = stacked.unpivot("experiment", fields, "field", "value")
    wide = long.groupBy("field").pivot("experiment", list(results)).agg(F.first("value"))
    return wide.fillna("-")


def stored_predictions(spark: SparkSession, path: str, metric: str, experiments: Sequence[str]) -> DataFrame:
    """(experiment, id, pred, true) of some experiments for one metric, from a table
    stored by (metric, experiment); only their folders are read."""
    stored = spark.read.parquet(path)
    mine = (F.col("metric") == metric) & F.col("experiment").isin(list(experiments))
    return stored.filter(mine).select("experiment", "id", "pred", "true")


def compare_stored(
    spark: SparkSession, path: str, out: str, metrics: Sequence[str], experiments: Sequence[str], exact: bool = False
) -> DataFrame:
    """p-value matrix of the stored predictions of every metric, stored by metric."""
    for metric in metrics:
        tables = contingency(stored_predictions(spark, path, metric, experiments))
        matrix = p_matrix(mcnemar(tables, exact=exact), list(experiments))
        write_table(matrix.withColumn("metric", F.lit(metric)), out, "metric")
    return spark.read.parquet(out)


def report_stored(
    spark: SparkSession, results: Mapping[str, str], out: str, metrics: Sequence[str]
) -> DataFrame:
    """The report of every metric, (field, one column per experiment), stored by metric.

    ``results`` names the folder of each experiment's own result table, which has a
    column ``metric`` and any others.
    """
    tables = {name: spark.read.parquet(path) for name, path in results.items()}
    for metric in metrics:
        report = experiment_report(tables, metric)
        write_table(report.withColumn("metric", F.lit(metric)), out, "metric")
    return spark.read.parquet(out)
