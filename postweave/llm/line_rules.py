"""Quality rules: repetition inside a text, and line frequency across documents.

All of it is DataFrame operations. A line is normalised and hashed; a host's
line is frequent when more distinct texts than a limit hold it. Frequent lines
go from every text but the first that holds them, and a document that loses
most of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import SPACE, Staging, let, words_of

# Distinct texts of a host that may hold a line.
MAX_TEXTS = 20
# A text keeps at least so many words, and such a share of them in percent.
MIN_WORDS = 20
MIN_LEFT = 30
# Words in repeated windows, in percent of all.
MAX_REPEATED = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Windows are told apart by 64-bit hashes, folded from word hashes by pairs,
    fours and eights. Only texts with an equal pair of hashes are sorted.
    """

    def folded(hashes: Column, step: int) -> Column:
        n = F.size(hashes) - step
        return F.zip_with(
            F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b)
        )

    def covered(windows: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(windows) - 1)
        pairs = F.sort_array(
            F.zip_with(windows, places, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def equal(s: Column, x: Column, i: Column) -> Column:
            same = [
                F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)
            ]
            return same[0] | same[1]

        twice = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: equal(s, x, i)), lambda x: x["i"]))
        parts = let(
            F.sort_array(twice),
            lambda p: F.transform(
                p, lambda x, i: F.least(F.lit(WINDOW), F.get(p, i + 1) - x)
            ),
        )
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    def counted(windows: Column) -> Column:
        unique = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(unique, F.lit(0)).otherwise(covered(windows))

    def hashed(w: Column) -> Column:
        ones = F.transform(w, lambda x: F.xxhash64(x))
        eights = let(ones, lambda h: let(folded(h, 1), lambda h2: let(folded(h2, 2), lambda h4: folded(h4, 4))))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(eights, counted))

    return hashed(words)


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, digits as 0, white space as single blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0")
    return F.xxhash64(F.trim(plain))


def measures(docs: DataFrame) -> DataFrame:
    """One row per document: its base figures and its lines as (key, words).

    Null texts count as empty; a null source is a host of its own.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    words = words_of(docs["text"])
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.transform(
                x, lambda y: F.struct(line_key(y).alias("key"), F.size(words_of(y)).alias("words"))
            ).alias("lines"),
        ),
    )
    symbols = F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        F.xxhash64(docs["source"]).alias("host"),
        F.xxhash64(text).alias("text_key"),
        base.alias("base"),
        symbols.alias("n_symbols"),
        of_lines.alias("of_lines"),
    ).select(
        "doc_id", "host", "text_key", "base.*", "n_symbols", "of_lines.n_dup_lines", "of_lines.lines"
    )


def frequent_lines(measured: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """(host, text_key, key, words, copies of the text summed) of lines to remove.

    Copies of a text are one text, so a group of exact copies makes no line
    frequent and shares one verdict. The first holder, smallest doc_id (null
    last), keeps the line.
    """
    held = (
        measured.select("doc_id", "host", "text_key", F.explode("lines").alias("l"))
        .groupBy("host", "l.key", "text_key")
        .agg(F.sum("l.words").alias("words"), F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first"))
    )
    counted = (
        held.groupBy("host", "key")
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.min(F.struct("first", "text_key")).alias("holder"),
        )
        .filter(F.col("n_texts") > max_texts)
        .select("host", "key", F.col("holder.text_key").alias("holder"))
    )
    return held.join(counted, ["host", "key"]).filter("text_key <> holder").select(
        "host", "text_key", "key", "words"
    )


def verdicts(
    spark: SparkSession,
    docs: DataFrame,
    max_texts: int = MAX_TEXTS,
    min_words: int = MIN_WORDS,
    min_left: int = MIN_LEFT,
) -> tuple[DataFrame, DataFrame]:
    """A verdict per document, and the stored lines to remove.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, words_left, kept, host, text_key. A document is
    kept if its base figures pass and the words left are at least ``min_words``
    and ``min_left`` percent. Repeated rows get equal verdicts, an empty table
    an empty result; other columns of ``docs`` are not read.
    """
    staging = Staging(spark)
    measured = staging(measures(docs), "line-measures")
    removed = staging(frequent_lines(measured, max_texts), "frequent-lines")
    copies = measured.groupBy("host", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    lost = (
        removed.groupBy("host", "text_key")
        .agg(F.sum("words").alias("all_words"))
        .join(copies, ["host", "text_key"])
        .select("host", "text_key", (F.col("all_words") / F.col("copies")).cast("long").alias("lost"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    left = F.col("words_left")
    rows = (
        measured.drop("lines")
        .join(lost, ["host", "text_key"], "left")
        .withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn(
            "kept",
            ~F.col("base_failed") & (left >= min_words) & (100 * left >= min_left * F.col("n_words")),
        )
        .drop("lost")
    )
    return rows, removed


def clean(
    spark: SparkSession, docs: DataFrame, max_texts: int = MAX_TEXTS
) -> DataFrame:
    """The kept documents with all their columns; frequent lines are cut from texts.

    A text without such a line stays as it is; n_chars follows a changed text.
    """
    rows, removed = verdicts(spark, docs, max_texts)
    keys = removed.groupBy("host", "text_key").agg(F.collect_set("key").alias("cut"))
    bad = rows.filter(~F.col("kept")).select("host", "text_key").distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.xxhash64(docs["source"]).alias("host"),
        F.xxhash64(text).alias("text_key"),
    )
    # A verdict depends on host and text alone, so it is joined by these.
    judged = own.join(bad, ["host", "text_key"], "left_anti").join(
        keys, ["host", "text_key"], "left"
    )
    line_is_kept = lambda x: ~F.array_contains(F.col("cut"), line_key(x)) | ~x.rlike(r"[^\x20\x09-\x0D]")
    shorter = F.array_join(F.filter(F.split(F.col("row.text"), "\n"), line_is_kept), "\n")
    fields = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == "text":
            value = F.when(F.col("cut").isNull(), value).otherwise(shorter)
        elif c == "n_chars":
            value = F.when(F.col("cut").isNull(), value).otherwise(
                F.char_length(shorter).cast(docs.schema[c].dataType)
            )
        fields.append(value.alias(c))
    return judged.select(*fields)
