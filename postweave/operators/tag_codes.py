"""Decode tags written as digit codes inside text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.session import broadcast_if_small


def decode_tags(
    df: DataFrame,
    id_col: str,
    text_col: str,
    digits: Sequence[str],
    tags: DataFrame | None,
) -> DataFrame:
    """Replace every coded run of a text by its tag, between blanks.

    A run ``zzzl..lzzz`` holds digit names joined by ``l``; a leading word is kept
    in front of the tag. ``digits`` names the digits 0 to 9, ``tags`` is
    (number, tag). An unknown digit or number raises. Without tags texts stay as
    they are.
    """
    if tags is None:
        return df.select(id_col, text_col)
    runs = F.array_distinct(F.regexp_extract_all(text_col, F.lit("zzz(.+?)zzz"), F.lit(0)))
    each = df.select(id_col, F.explode(runs).alias("run"))
    bare = F.trim(F.replace(F.replace("run", F.lit("zzzl"), F.lit(" ")), F.lit("lzzz"), F.lit(" ")))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    code = F.when(F.size(words) > 1, words[1]).otherwise(words[0])
    names = F.array(*[F.lit(d) for d in digits])
    places = F.transform(F.split(code, "l"), lambda d: F.array_position(names, d) - 1)
    number = F.aggregate(places, F.lit(0).cast("long"), lambda acc, d: acc * 10 + d)
    known = ~F.exists(places, lambda d: d < 0)
    wrong = F.raise_error(F.concat(F.lit("wrongly coded tag: "), F.col("run")))
    coded = each.select(
        id_col,
        "run",
        F.when(F.size(words) > 1, F.concat(words[0], F.lit(" "))).otherwise("").alias("lead"),
        F.when(known, number).otherwise(wrong.cast("long")).alias("number"),
    )
    named = coded.join(broadcast_if_small(tags), "number", "left")
    tag = F.coalesce(F.col("tag"), wrong.cast("string"))
    spelled = named.select(
        id_col, F.struct("run", F.concat("lead", tag).alias("word")).alias("entry")
    )
    entries = spelled.groupBy(id_col).agg(F.collect_list("entry").alias("entries"))
    text = F.aggregate(
        F.coalesce("entries", F.array().cast("array<struct<run:string,word:string>>")),
        F.col(text_col),
        lambda acc, e: F.replace(acc, e["run"], F.concat(F.lit(" "), e["word"], F.lit(" "))),
    )
    joined = df.select(id_col, text_col).join(entries, id_col, "left")
    return joined.select(id_col, F.trim(text).alias(text_col))
