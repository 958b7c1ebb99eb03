"""Tag shares and the distribution of tags per post."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweave.functions.text import tag_count, tag_set


def tag_share(df: DataFrame, tags_col: str, *by: str) -> DataFrame:
    """(by.., tag, posts, share): posts holding a tag over all posts.

    Repeats in a post count once; a post without a list holds the tag ''.
    """
    posts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("all_posts"))
    each = df.select(*by, F.explode_outer(tag_set(F.col(tags_col))).alias("tag"))
    counts = each.groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("posts"))
    if by:
        counts = counts.join(posts, list(by))
    else:
        counts = counts.withColumn("all_posts", posts.select("all_posts").scalar())
    return counts.select(*by, "tag", "posts", (F.col("posts") / F.col("all_posts")).alias("share"))


def ranked_tags(shares: DataFrame, n: int, skip: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` most frequent tags after the first ``skip`` (the campaign tag)."""
    order = Window.partitionBy(*by).orderBy(F.desc("posts"), "tag")
    if not by:
        top = shares.orderBy(F.desc("posts"), "tag").limit(n + skip)
        ranked = top.withColumn("rank", F.row_number().over(order))
        return ranked.filter(F.col("rank") > skip)
    ranked = shares.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= n + skip) & (F.col("rank") > skip))


def tags_per_post(df: DataFrame, tags_col: str, *by: str) -> DataFrame:
    """Frequency table (by.., n_tags, posts): everything below is computed from it."""
    sized = df.select(*by, tag_count(F.col(tags_col)).alias("n_tags"))
    return sized.groupBy(*by, "n_tags").agg(F.count(F.lit(1)).alias("posts"))


def count_summary(freq: DataFrame, *by: str) -> DataFrame:
    """Mean, median, population deviation, 1st and 99th percentile, exact."""
    n, w = F.col("n_tags"), F.col("posts")
    mean = F.sum(n * w) / F.sum(w)

    def pct(p: float):
        return F.percentile(n, F.lit(p), w)

    return freq.groupBy(*by).agg(
        mean.alias("mean"),
        pct(0.5).alias("median"),
        F.sqrt(F.sum(n * n * w) / F.sum(w) - mean * mean).alias("stdev"),
        pct(0.01).alias("p01"),
        pct(0.99).alias("p99"),
        F.max(n).alias("longest"),
    )


def unit_histogram(freq: DataFrame, *by: str) -> DataFrame:
    """Share of posts per bin with edges 0, 1, .., longest - 1.

    The last bin is closed on the right and values equal to the longest list lie
    outside, but shares stay relative to all posts. Bins are keyed by left edge.
    """
    whole = Window.partitionBy(*by)
    sized = freq.withColumn("longest", F.max("n_tags").over(whole)).withColumn(
        "all_posts", F.sum("posts").over(whole)
    )
    inside = sized.filter(F.col("n_tags") < F.col("longest"))
    # The value longest - 1 falls in the closed last bin, which starts one lower.
    left = F.least(F.col("n_tags"), F.greatest(F.col("longest") - 2, F.lit(0)))
    return inside.groupBy(*by, left.alias("bin")).agg(
        F.sum("posts").alias("posts"),
        (F.sum("posts") / F.max("all_posts")).alias("share"),
    )


def even_histogram(freq: DataFrame, *by: str) -> DataFrame:
    """Share of posts per equal-width bin, as many bins as the longest list."""
    whole = Window.partitionBy(*by)
    sized = (
        freq.withColumn("low", F.min("n_tags").over(whole))
        .withColumn("longest", F.max("n_tags").over(whole))
        .withColumn("all_posts", F.sum("posts").over(whole))
    )
    width = F.col("longest") - F.col("low")
    place = F.floor((F.col("n_tags") - F.col("low")) * F.col("longest") / F.nullif(width, F.lit(0)))
    # One value only: the range is widened by a half on both sides, so it sits mid-way.
    bin_ = F.coalesce(F.least(place, F.col("longest") - 1), F.floor(F.col("longest") / 2))
    return sized.groupBy(*by, bin_.alias("bin")).agg(
        F.sum("posts").alias("posts"),
        (F.sum("posts") / F.max("all_posts")).alias("share"),
    )


def chart_limits(shares: DataFrame, freq: DataFrame) -> DataFrame:
    """Axis limits over datasets: largest second-ranked share, longest list."""
    second = ranked_tags(shares, 1, 1, ("dataset",))
    return second.agg(F.max("share").alias("share_limit")).withColumn(
        "length_limit", freq.agg(F.max("n_tags")).scalar()
    )
