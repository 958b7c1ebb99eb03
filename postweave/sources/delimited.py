"""Delimited post files, lexicons and two-header exports."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postweave.sources.records import read_records

TEXT_TYPES = ("csv", "txt")


def files_spanning_lines(spark: SparkSession, path: str | list[str], quote: str = '"') -> set[str]:
    """Files in which some record may hold a line break: a line with an odd number
    of quotes. One parallel pass; the names of such files reach the driver."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))
    odd = spark.read.text(path).filter(quotes % 2 == 1)
    return {unquote(r[0]) for r in odd.select(F.input_file_name()).distinct().collect()}


def spans_lines(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether any file of ``path`` may hold a record over several lines."""
    return bool(files_spanning_lines(spark, path, quote))


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    sep: str = ",",
    kind: str = "csv",
    multiline: bool | None = None,
) -> DataFrame:
    """Read delimited files with a header row.

    With ``multiline`` unset the files are checked first. Files whose records keep to
    their lines are read as they are; of the others the records are put together from
    byte ranges, so that one large file is the work of many tasks too.
    """
    if kind not in TEXT_TYPES:
        raise ValueError(f"unsupported source type: {kind}")
    options = {
        "sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    }
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def plain(paths: str | list[str]) -> DataFrame:
        return spark.read.options(header=True, **options).schema(schema).csv(paths)

    def spanning(paths: list[str]) -> DataFrame:
        row = F.from_csv("record", schema.toDDL(), options)
        # Rows keep the order of their file: of a repeated word the last one counts.
        ordered = read_records(spark, paths, sep).orderBy("file", "block", "place")
        return ordered.select(row.alias("row")).select("row.*")

    if multiline is False:
        return plain(path)
    files = {unquote(f) for f in spark.read.text(path).inputFiles()}
    odd = files if multiline else files_spanning_lines(spark, path)
    if not odd:
        return plain(path)
    found = spanning(sorted(odd))
    rest = sorted(files - odd)
    return plain(rest).unionByName(found) if rest else found


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


LEXICON_SCHEMA = "Word string, valence double, dominance double, arousal double"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, valence, dominance, arousal); of a repeated word the last row counts."""
    rows = read_delimited(spark, path, LEXICON_SCHEMA)
    return last_per_word(
        rows.withColumnRenamed("Word", "word"), F.monotonically_increasing_id()
    )


def last_per_word(rows: DataFrame, position) -> DataFrame:
    placed = rows.withColumn("_at", position)
    scores = [c for c in rows.columns if c != "word"]
    last = placed.groupBy("word").agg(F.max_by(F.struct(*scores), "_at").alias("s"))
    return last.select("word", *[F.col(f"s.{c}").alias(c) for c in scores])


def read_two_header(
    spark: SparkSession, path: str, id_col: str, first_kept: str = "WC", sep: str = ","
) -> DataFrame:
    """A word-category export whose first data row (row 0) holds the original names.

    The id column is the one named ``id_col`` there; kept are the id and, as
    doubles, everything from the header column ``first_kept`` rightward.
    """
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", spans_lines(spark, path))
        .csv(path)
    )
    # Row 0 of each file; of several files, as Spark writes them, one has the names.
    cells = F.array(*[F.col(f"`{c}`") for c in raw.columns])
    block = F.col("_metadata.file_block_start")
    firsts = (
        raw.select(
            cells.alias("cells"), F.col("_metadata.file_path").alias("file"), block.alias("block"),
            F.monotonically_increasing_id().alias("place"),
        )
        .filter("block = 0")
        .groupBy("file")
        .agg(F.min_by("cells", "place").alias("cells"))
    )
    found = firsts.filter(F.array_contains("cells", id_col)).first()
    if found is None or first_kept not in raw.columns:
        raise ValueError(f"no first row names {id_col!r} or no column {first_kept!r}")
    names = found.cells
    at = names.index(id_col)
    kept = raw.columns[raw.columns.index(first_kept):]
    source = F.col(f"`{raw.columns[at]}`")
    # Only rows equal to the first one hold names: that of each file.
    is_names = F.lit(True)
    for c, name in zip(raw.columns, names):
        is_names = is_names & F.col(f"`{c}`").eqNullSafe(F.lit(name))
    body = raw.filter(~is_names)
    return body.select(
        source.alias(id_col), *[F.col(f"`{c}`").cast("double").alias(c) for c in kept]
    )
