"""Term dictionaries fitted on training posts, and counts over them."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.stem import stems
from postweave.functions.text import clean, concat_columns, drop_stop_words, or_empty_token, tokens
from postweave.operators.in_row import row_counts, small
from postweave.presets import KEEP_TERMS, REPLACEMENTS


def prepare_text(
    df: DataFrame,
    id_col: str,
    cols: list[str],
    replacements=REPLACEMENTS,
    stemming: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, orig_text, cleaned_text, final_text) with final_text an array of terms."""
    orig = df.select(
        id_col, concat_columns([F.col(c) for c in cols]).alias("orig_text"), *keep
    )
    cleaned = orig.withColumn("cleaned_text", clean(F.col("orig_text"), replacements))
    words = drop_stop_words(tokens(F.col("cleaned_text")))
    # Two projections, so that the tokens are computed once for test and value.
    made = cleaned.withColumn("final_text", stems(words) if stemming else words)
    return made.select(
        id_col, "orig_text", "cleaned_text",
        or_empty_token(F.col("final_text")).alias("final_text"), *keep,
    )


def document_frequency(df: DataFrame, terms_col: str = "final_text") -> DataFrame:
    """(term, df): number of posts holding each term."""
    each = df.select(F.explode_outer(F.array_distinct(terms_col)).alias("term"))
    return each.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_dictionary(
    train: DataFrame,
    no_below: int,
    no_above: float,
    terms_col: str = "final_text",
    keep: int = KEEP_TERMS,
) -> DataFrame:
    """Terms of at least ``no_below`` posts and at most the share ``no_above`` of
    them (bound cut to an integer), the ``keep`` most frequent: (term, df).

    At most ``keep`` rows, so the result may be broadcast.
    """
    highest = train.agg(F.floor(F.count(F.lit(1)) * F.lit(float(no_above)))).scalar()
    counts = document_frequency(train, terms_col)
    within = counts.filter((F.col("df") >= no_below) & (F.col("df") <= highest))
    return within.orderBy(F.desc("df"), "term").limit(keep)


def term_counts(
    df: DataFrame,
    id_col: str,
    dictionary: DataFrame,
    terms_col: str = "final_text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep.., term, n) over dictionary terms; other terms are dropped.

    Counted within the post's row, without a shuffle; a dictionary too large to
    broadcast is joined instead, where repeats within a post combine first.
    """
    known = small(dictionary.select("term"))
    if known is not None:
        return row_counts(df, [id_col, *keep], F.col(terms_col), known.column("term").combine_chunks())
    each = df.select(id_col, *keep, F.explode_outer(terms_col).alias("term"))
    counted = each.join(dictionary.select("term"), "term")
    return counted.groupBy(id_col, *keep, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(dictionary: DataFrame) -> list[str]:
    """Dictionary terms in order of frequency; bounded by the dictionary's size."""
    rows = dictionary.orderBy(F.desc("df"), "term").select("term").collect()
    return [r.term for r in rows]


def count_vectors(
    df: DataFrame, terms: list[str], terms_col: str = "final_text", out: str = "bow"
) -> DataFrame:
    """Sparse term counts as a vector column, without a shuffle."""
    if not terms:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    model = CountVectorizerModel.from_vocabulary(terms, inputCol=terms_col, outputCol=out)
    return model.transform(df)

