"""Staged tables, connected components and small expression helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.session import scratch_path, ship_package

# White space of all word rules: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Executors get this package before the first Python task."""
    ship_package(spark)
    return spark


class Staging:
    """Tables written to the shared folder, deleted when no later plan reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = path
        return stored

    def drop(self, stored: DataFrame) -> None:
        path = self.paths.pop(id(stored), None)
        if path is None:
            return
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        place.getFileSystem(conf).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps until the links are stars. Each
    step is two joins on aggregated minima, so a hub is never gathered in one
    task; each round is written to the shared folder and replaces the last.
    Null ends and loops are ignored; no edges give an empty table.
    """
    staging = Staging(spark)
    links = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("a is not null and b is not null and a <> b")
    links = staging(links.distinct(), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .filter("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                    F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        after = staging(small, "links")
        staging.drop(links)
        links, before, state = after, state, _state(after)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    """Fingerprint of a set of links, to see whether a round changed it."""
    key = F.xxhash64("u", "v")
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.sum(key.cast("decimal(38,0)")), F.bit_xor(key)
        ).first()
    )
