"""Stage tables: folds, features by key, predictions, metric results."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *partition_by: str, csv: bool = False) -> None:
    """Overwrite a table; with partition columns only the partitions at hand."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if csv:
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def append_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a catalog table."""
    writer = df.write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def _number(value: object) -> str:
    return value if isinstance(value, str) else str(1.0 * value)


def feature_key(
    project: str, kind: str, name: str, params: Mapping[str, object], cv: int | str
) -> str:
    """Name of a fitted feature; numbers read as floats (1 becomes 1.0)."""
    values = "_".join(_number(v) for v in params.values())
    return f"{project}_{kind}({name})_{values}_cv({cv})"


def feature_key_column(
    project: str, kind: Column, name: Column, values: Sequence[Column], cv: Column
) -> Column:
    """The same key as a column; NULL parameters are left out."""
    return F.concat(
        F.lit(f"{project}_"), kind, F.lit("("), name, F.lit(")_"),
        F.concat_ws("_", *values), F.lit("_cv("), cv.cast("string"), F.lit(")"),
    )


def experiment_key(
    project: str, grid: str, algorithm: str, static: Sequence[str], dynamic: Mapping[str, str]
) -> str:
    """Name of an experiment from its grid, learner and selected features."""
    fitted = "_".join(f"{kind}({name})" for name, kind in dynamic.items())
    return f"{project}_{grid}_{algorithm}_{'_'.join(static)}_{fitted}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _note(spark: SparkSession, folder: str, key: str, row: tuple, schema: str) -> None:
    """One row in a folder of its own, so that any number of writers may note at once."""
    entry = hashlib.md5(key.encode()).hexdigest()
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/entry={entry}")


def finished(spark: SparkSession, ledger: str) -> set[str]:
    """Keys recorded in a ledger, at most one per cell of a configured grid."""
    if not exists(spark, ledger):
        return set()
    return {r.key for r in spark.read.schema("key string").parquet(ledger).select("key").collect()}


def record(spark: SparkSession, ledger: str, key: str) -> None:
    """Note a key as finished; call it after what the key stands for is stored."""
    _note(spark, ledger, key, (key,), "key string")


MANIFEST = "feature string, param_key string, cv string, kind string"


def write_feature(df: DataFrame, root: str, name: str, key: str, cv: int | str) -> None:
    """Store a fitted feature under (param_key, cv) in the folder of its name.

    Each feature has a folder and so a schema of its own: arrays, vectors and
    numbers lie side by side. The manifest names a feature only after its data are
    written, so a feature of a broken run is fitted again.
    """
    keyed = df.withColumns({"param_key": F.lit(key), "cv": F.lit(str(cv))})
    write_table(keyed, f"{root}/{name}", "param_key", "cv")
    kind = df.schema["features"].dataType.simpleString() if "features" in df.columns else ""
    _note(df.sparkSession, f"{root}-manifest", key, (name, key, str(cv), kind), MANIFEST)


def feature_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(feature, param_key, cv, kind) of every feature that is stored whole."""
    if not exists(spark, f"{root}-manifest"):
        return spark.createDataFrame([], MANIFEST)
    noted = spark.read.schema(MANIFEST).parquet(f"{root}-manifest")
    return noted.select("feature", "param_key", "cv", "kind")


def read_features(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Everything stored of one feature: (id, features, param_key, cv)."""
    path = f"{root}/{name}"
    whole = spark.read.option("basePath", path).parquet(path).withColumn("cv", F.col("cv").cast("string"))
    done = feature_manifest(spark, root).filter(F.col("feature") == name).select("param_key", "cv")
    return whole.join(F.broadcast(done), ["param_key", "cv"], "left_semi")


def read_feature(
    spark: SparkSession, root: str, name: str, key: str, cv: int | str
) -> DataFrame:
    """One fitted feature; only its partition is read."""
    path = f"{root}/{name}"
    stored = spark.read.option("basePath", path).parquet(path)
    return stored.filter(
        (F.col("param_key") == key) & (F.col("cv").cast("string") == str(cv))
    ).drop("param_key", "cv")
