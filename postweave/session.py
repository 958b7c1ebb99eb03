"""Scratch space and size checks shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 500_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application.

    Not needed where the package is installed on the cluster.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="postweave-"), "postweave")
    archive = shutil.make_archive(
        target, "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="postweave-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    Cuts lineage for iterative jobs, survives lost executors, and gives the
    optimizer real sizes for the joins that follow.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.__dict__["_stage_path"] = path
    return stored


def unstage(stored: DataFrame | None) -> None:
    """Delete a table that ``stage`` returned; no later plan may read it."""
    path = None if stored is None else stored.__dict__.pop("_stage_path", None)
    if path is None:
        return
    spark = stored.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage_until(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, bool]:
    """``stage``, and whether no stored row meets ``condition`` any more."""
    stored = stage(df, name)
    return stored, stored.filter(condition).limit(1).count() == 0


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted to be small.

    Larger inputs come back without a hint and join by shuffle. ``df`` should
    be a stored or cheap table: the count reads it.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
