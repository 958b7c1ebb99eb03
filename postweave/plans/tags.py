"""Tag shares and tag-count distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.functions.text import tag_statistics
from postweave.operators import tag_stats as ts
from postweave.plans.registry import query
from postweave.plans.views import (
    BOTH_TAGGED_SQL,
    TAGGED_SQL,
    both_tagged,
    tag_rows_sql,
    tagged,
)

_SHARE_SQL = f"""{TAGGED_SQL}, rows_ AS ({tag_rows_sql('tagged')}),
  shares AS (SELECT tag, count(*) AS posts,
    round(count(*) / (SELECT count(*) FROM tagged), 9) AS share FROM rows_ GROUP BY tag)"""

_BY_SQL = f"""{BOTH_TAGGED_SQL}, rows_ AS ({tag_rows_sql('both_tagged', 'dataset')}),
  totals AS (SELECT dataset, count(*) AS n FROM both_tagged GROUP BY dataset),
  shares AS (SELECT dataset, tag, count(*) AS posts, round(count(*) / any_value(n), 9) AS share
    FROM rows_ JOIN totals USING (dataset) GROUP BY dataset, tag)"""

_LENGTHS_SQL = """sizes AS (SELECT dataset,
    CASE WHEN tags IS NULL THEN 1 ELSE len(string_split(tags, ',')) END AS n FROM both_tagged),
  ext AS (SELECT dataset, min(n) AS low, max(n) AS high, count(*) AS total
    FROM sizes GROUP BY dataset)"""


def _rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("tag_share", f"WITH {_SHARE_SQL} SELECT * FROM shares")
def tag_share(spark, sf):
    return _rounded(ts.tag_share(tagged(spark, sf), "tags"), "share")


@query("tag_share_by_dataset", f"WITH {_BY_SQL} SELECT * FROM shares")
def tag_share_by_dataset(spark, sf):
    return _rounded(ts.tag_share(both_tagged(spark, sf), "tags", "dataset"), "share")


@query(
    "top_tags_skip_first",
    f"""WITH {_SHARE_SQL}, r AS (SELECT *,
          row_number() OVER (ORDER BY posts DESC, tag) AS rank FROM shares)
        SELECT * FROM r WHERE rank BETWEEN 2 AND 21""",
)
def top_tags_skip_first(spark, sf):
    shares = ts.tag_share(tagged(spark, sf), "tags")
    return _rounded(ts.ranked_tags(shares, 20), "share")


@query(
    "top_tags_by_dataset",
    f"""WITH {_BY_SQL}, r AS (SELECT *, row_number() OVER (
          PARTITION BY dataset ORDER BY posts DESC, tag) AS rank FROM shares)
        SELECT * FROM r WHERE rank BETWEEN 2 AND 11""",
)
def top_tags_by_dataset(spark, sf):
    shares = ts.tag_share(both_tagged(spark, sf), "tags", "dataset")
    return _rounded(ts.ranked_tags(shares, 10, by=("dataset",)), "share")


@query(
    "tags_per_post_stats",
    f"""WITH {BOTH_TAGGED_SQL}, {_LENGTHS_SQL}
        SELECT dataset, round(avg(n), 6) AS mean, round(median(n), 6) AS median,
          round(stddev_pop(n), 6) AS stdev, round(quantile_cont(n, 0.01), 6) AS p01,
          round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest
        FROM sizes GROUP BY dataset""",
)
def tags_per_post_stats(spark, sf):
    freq = ts.tags_per_post(both_tagged(spark, sf), "tags", "dataset")
    summary = ts.count_summary(freq, "dataset")
    return _rounded(summary, "mean", "median", "stdev", "p01", "p99", digits=6)


@query(
    "tags_per_post_hist_unit",
    f"""WITH {BOTH_TAGGED_SQL}, {_LENGTHS_SQL}
        SELECT dataset, least(n, greatest(high - 2, 0)) AS bin, count(*) AS posts,
          round(count(*) / any_value(total), 9) AS share
        FROM sizes JOIN ext USING (dataset) WHERE n < high GROUP BY ALL""",
)
def tags_per_post_hist_unit(spark, sf):
    freq = ts.tags_per_post(both_tagged(spark, sf), "tags", "dataset")
    return _rounded(ts.unit_histogram(freq, "dataset"), "share")


@query(
    "tags_per_post_hist_even",
    f"""WITH {BOTH_TAGGED_SQL}, {_LENGTHS_SQL}
        SELECT dataset, CAST(CASE WHEN high = low THEN floor(high / 2)
            ELSE least(floor((n - low) * high / (high - low)), high - 1) END AS BIGINT) AS bin,
          count(*) AS posts, round(count(*) / any_value(total), 9) AS share
        FROM sizes JOIN ext USING (dataset) GROUP BY ALL""",
)
def tags_per_post_hist_even(spark, sf):
    freq = ts.tags_per_post(both_tagged(spark, sf), "tags", "dataset")
    return _rounded(ts.even_histogram(freq, "dataset"), "share")


@query(
    "peak_bin_share",
    f"""WITH {BOTH_TAGGED_SQL}, {_LENGTHS_SQL}, bins AS (
          SELECT dataset, least(n, greatest(high - 2, 0)) AS bin,
            count(*) / any_value(total) AS share
          FROM sizes JOIN ext USING (dataset) WHERE n < high GROUP BY ALL)
        SELECT round(max(share), 9) AS peak FROM bins""",
)
def peak_bin_share(spark, sf):
    freq = ts.tags_per_post(both_tagged(spark, sf), "tags", "dataset")
    return ts.unit_histogram(freq, "dataset").agg(F.round(F.max("share"), 9).alias("peak"))


@query(
    "chart_limits",
    f"""WITH {_BY_SQL}, r AS (SELECT *, row_number() OVER (
          PARTITION BY dataset ORDER BY posts DESC, tag) AS rank FROM shares), {_LENGTHS_SQL}
        SELECT max(share) AS share_limit, (SELECT max(n) FROM sizes) AS length_limit
        FROM r WHERE rank = 2""",
)
def chart_limits(spark, sf):
    posts = both_tagged(spark, sf)
    shares = ts.tag_share(posts, "tags", "dataset")
    freq = ts.tags_per_post(posts, "tags", "dataset")
    return _rounded(ts.chart_limits(shares, freq), "share_limit")


@query(
    "tag_count_mean_len",
    f"""WITH {TAGGED_SQL} SELECT id,
          CASE WHEN tags IS NULL THEN 0.0 ELSE len(string_split(tags, ',')) END::DOUBLE
            AS hashtags_count,
          CASE WHEN tags IS NULL THEN 0.0 ELSE round(list_sum(list_transform(
            string_split(tags, ','), lambda t: length(trim(t)))) / len(string_split(tags, ',')), 9)
          END AS hashtags_sum FROM tagged""",
)
def tag_count_mean_len(spark, sf):
    count, mean = tag_statistics(F.col("tags"))
    return tagged(spark, sf).select(
        "id", count.alias("hashtags_count"), F.round(mean, 9).alias("hashtags_sum")
    )


