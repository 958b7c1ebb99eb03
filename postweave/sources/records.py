"""Records of delimited files whose quoted fields hold line breaks, read in many tasks.

Lines are read by byte range. What a line does to the question "inside quotes?" is one
of four functions on two states, so the state at the start of every line follows from
running sums: first inside each range, then over the ranges of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from postweave.session import broadcast_if_small, stage

# What stands before the next quote of a line.
CLOSED, INSIDE, BARE = 0, 1, 2


def ends_inside(line: Column, sep: str, quote: str, start: int) -> Column:
    """Whether ``line`` ends within a quoted field if it begins in state ``start``.

    A quote opens a field only at its start, doubled quotes stay inside, and quotes
    within an unquoted field are plain characters.
    """
    pieces = F.split(line, f"\\Q{quote}\\E", -1)

    def step(state: Column, piece: Column) -> Column:
        opens = ((state == CLOSED) & (piece == "")) | piece.endswith(sep)
        return (
            F.when(state == INSIDE, F.lit(CLOSED)).when(opens, F.lit(INSIDE)).otherwise(F.lit(BARE))
        )

    last = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.lit(start), step)
    return F.when(F.contains(line, F.lit(quote)), last == INSIDE).otherwise(F.lit(start == INSIDE))


def with_states(df: DataFrame, order: WindowSpec) -> DataFrame:
    """Add ``if_out`` and ``if_in``: the state before a row if the first row of its
    window begins outside or inside. The columns ``from_out`` and ``from_in`` say how a row
    ends; equal ones set the state whatever it was, swapped ones turn it round."""
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("from_out") & ~F.col("from_in")
    fixed = F.col("from_out") == F.col("from_in")
    turned = df.withColumn("_turned", F.sum(turns.cast("long")).over(here) % 2 == 1)
    # The state set by the last fixing row, as if no row before it had turned.
    known = F.last(F.when(fixed, F.col("from_out") != F.col("_turned")), ignorenulls=True)
    before = F.col("_turned") != turns
    placed = turned.withColumn("_known", known.over(earlier))
    return placed.withColumns({
        f"if_{name}": F.coalesce("_known", F.lit(first)) != before
        for name, first in (("out", False), ("in", True))
    }).drop("_turned", "_known")


def _after(state: str) -> Column:
    """How a row ends that begins in the state of that column."""
    return F.when(F.col(state), F.col("from_in")).otherwise(F.col("from_out"))


def read_lines(spark: SparkSession, paths: list[str], sep: str, quote: str) -> DataFrame:
    """Stored lines with file, range, place, and for either state at the start of the
    range the state before the line and the place where its open record began."""
    at = F.col("_metadata.file_block_start")
    lines = (
        spark.read.option("lineSep", "\n").text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"), at.alias("block"),
            F.monotonically_increasing_id().alias("place"),
            F.regexp_replace("value", "\r$", "").alias("value"),
        )
        .withColumn("from_out", ends_inside(F.col("value"), sep, quote, CLOSED))
        .withColumn("from_in", ends_inside(F.col("value"), sep, quote, INSIDE))
    )
    order = Window.partitionBy("file", "block").orderBy("place")
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_states(lines, order)
    return stage(
        placed.withColumns({
            f"open_{name}": F.max(
                F.when(~F.col(f"if_{name}") & _after(f"if_{name}"), F.col("place"))
            ).over(here)
            for name in ("out", "in")
        }).withColumn("header", (F.col("block") == 0) & (F.row_number().over(order) == 1)),
        "lines",
    )


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, carried): the state at the start of each byte range and where the
    record open there began. One row per range."""
    ends = lines.groupBy("file", "block").agg(
        F.max_by(_after("if_out"), "place").alias("from_out"),
        F.max_by(_after("if_in"), "place").alias("from_in"),
        F.max("open_out").alias("open_out"), F.max("open_in").alias("open_in"),
    )
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # A file begins outside.
    placed = with_states(ends, order).withColumnRenamed("if_out", "inside")
    opened = F.when(F.col("inside"), F.col("open_in")).otherwise(F.col("open_out"))
    return placed.withColumn("carried", F.max(opened).over(earlier)).select(
        "file", "block", "inside", "carried"
    )


def read_records(
    spark: SparkSession, paths: list[str], sep: str = ",", quote: str = '"'
) -> DataFrame:
    """(file, block, place, record): the records of delimited files without their header
    records; block and place order them as the file does.

    Only lines of records that span lines are grouped, so a record costs one task its
    own size. Line ends inside quotes become line feeds; blank lines between records
    give none; a quote that never closes takes the rest of its file.
    """
    lines = read_lines(spark, paths, sep, quote)
    placed = lines.join(broadcast_if_small(block_states(lines)), ["file", "block"])
    placed = placed.withColumn(
        "within", F.when(F.col("inside"), F.col("if_in")).otherwise(F.col("if_out"))
    )
    opened = F.when(F.col("inside"), F.col("open_in")).otherwise(F.col("open_out"))
    whole = ~F.col("within") & ~_after("within")
    single = placed.filter(whole & ~F.col("header") & (F.trim("value") != ""))
    spanning = (
        placed.filter(~whole)
        .withColumn("began", F.coalesce(opened, F.col("carried")))
        .groupBy("file", "began")
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "place", "value"))).alias("parts"),
            F.bool_or("header").alias("header"), F.min("block").alias("block"),
        )
        .filter(~F.col("header"))
    )
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return single.select("file", "block", "place", F.col("value").alias("record")).unionByName(
        spanning.select("file", "block", F.col("began").alias("place"), joined.alias("record"))
    )
