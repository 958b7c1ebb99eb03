"""Sources, dates, labels, samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave import presets
from postweave.functions.dates import (
    account_age_days,
    epoch_to_timestamp,
    parse_date,
    timestamp_to_epoch,
)
from postweave.operators import folds as fo
from postweave.operators import grid as gr
from postweave.operators import prepare as pr
from postweave.plans.registry import query
from postweave.plans.views import (
    INNER,
    LABELLED_SQL,
    OUTER,
    POSTS_SQL,
    SEED,
    TAGGED_SQL,
    labelled,
    posts,
    sample_sql,
    table,
    tagged,
)
from postweave.session import scratch_path
from postweave.sources import delimited, store

LOW, HIGH = "1996-05-01", "1999-11-01"


@query(
    "csv_import_typed",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS created,
         (SELECT count(*) FROM orders) AS rows_read FROM orders""",
)
def csv_import_typed(spark, sf):
    orders = table(spark, sf, "orders")
    path = scratch_path(spark, "orders-tsv")
    raw = orders.select(
        "o_orderkey",
        "o_orderpriority",
        "o_totalprice",
        F.date_format("o_orderdate", "MMM dd yyyy").alias("created"),
    )
    delimited.write_delimited(raw, path, sep="\t")
    schema = "o_orderkey long, o_orderpriority string, o_totalprice double, created string"
    read = delimited.read_delimited(spark, path, schema, sep="\t", kind="txt")
    return read.withColumns(
        {
            "created": F.date_format(parse_date(F.col("created")), "yyyy-MM-dd"),
            "rows_read": read.agg(F.count(F.lit(1))).scalar(),
        }
    )


@query(
    "csv_import_multiline",
    """SELECT doc_id, length(text) AS chars, md5(text) AS digest, count(*) OVER () AS rows_read
       FROM documents""",
)
def csv_import_multiline(spark, sf):
    """Texts with line breaks written to files, their records put together from byte ranges."""
    path = scratch_path(spark, "documents-csv")
    delimited.write_delimited(table(spark, sf, "documents").select("doc_id", "text"), path)
    read = delimited.read_delimited(spark, path, "doc_id long, text string", multiline=True)
    digest = F.md5(F.col("text").cast("binary"))
    return read.select("doc_id", F.length("text").alias("chars"), digest.alias("digest")).withColumn(
        "rows_read", read.agg(F.count(F.lit(1))).scalar()
    )


@query(
    "date_filter_range",
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders
        WHERE o_orderdate BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'""",
)
def date_filter_range(spark, sf):
    kept = pr.date_range(table(spark, sf, "orders"), "o_orderdate", LOW, HIGH)
    return kept.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query(
    "date_bounds",
    """WITH d AS (SELECT 'orders' AS dataset, o_orderdate AS ts FROM orders
         UNION ALL SELECT 'events', ts FROM events)
       SELECT dataset, strftime(min(ts), '%Y-%m-%d') AS min_date,
         strftime(max(ts), '%Y-%m-%d') AS max_date, count(*) AS "rows" FROM d GROUP BY dataset""",
)
def date_bounds(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.lit("orders").alias("dataset"), F.col("o_orderdate").alias("ts")
    )
    events = table(spark, sf, "events").select(F.lit("events").alias("dataset"), "ts")
    bounds = pr.date_bounds(orders.unionByName(events), "ts", "dataset")
    return bounds.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("min_date", "max_date")}
    )


@query(
    "epoch_roundtrip",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
         strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS back FROM events""",
)
def epoch_roundtrip(spark, sf):
    events = table(spark, sf, "events")
    epoch = timestamp_to_epoch(F.col("ts"))
    text = events.select("event_id", epoch.alias("epoch"), epoch.cast("string").alias("t"))
    back = F.date_format(epoch_to_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss")
    return text.select("event_id", "epoch", back.alias("back"))


@query(
    "account_age_days",
    """SELECT o_orderkey, date_diff('day', DATE '2005-01-01', CAST(o_orderdate AS DATE)) AS age
       FROM orders""",
)
def account_age(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", account_age_days(F.col("o_orderdate")).alias("age")
    )


@query(
    "label_boolean_nullsafe",
    f"WITH {POSTS_SQL} SELECT doc_id, coalesce(engagement > 0, false) AS label FROM posts",
)
def label_boolean(spark, sf):
    return pr.label_table(posts(spark, sf), "doc_id", "engagement")


@query("label_passthrough", "SELECT doc_id, lang AS label FROM documents")
def label_passthrough(spark, sf):
    return pr.label_table(table(spark, sf, "documents"), "doc_id", "lang", kind="multiclass")


@query("class_labels", "SELECT DISTINCT lang AS label FROM documents")
def class_labels(spark, sf):
    return pr.distinct_labels(label_passthrough(spark, sf))


@query(
    "class_counts",
    f"""WITH {POSTS_SQL}, l AS (SELECT coalesce(engagement > 0, false) AS label FROM posts)
        SELECT label, count(*) AS "rows" FROM l GROUP BY label""",
)
def class_counts(spark, sf):
    return pr.class_counts(label_boolean(spark, sf))


_POST_LABELS = f"""{POSTS_SQL}, post_labels AS (
  SELECT doc_id, coalesce(engagement > 0, false) AS label FROM posts)"""


@query(
    "class_balance",
    f"WITH {_POST_LABELS}, {sample_sql('post_labels')} SELECT doc_id, label FROM sample",
)
def class_balance(spark, sf):
    return fo.balanced_sample(label_boolean(spark, sf), "doc_id", SEED).select("doc_id", "label")


@query(
    "class_balance_multiclass",
    "WITH langs AS (SELECT doc_id, lang AS label FROM documents), "
    f"{sample_sql('langs')} SELECT doc_id, label FROM sample",
)
def class_balance_multiclass(spark, sf):
    return fo.balanced_sample(label_passthrough(spark, sf), "doc_id", SEED).select(
        "doc_id", "label"
    )


def post_folds(spark, sf, only=None):
    sample = fo.balanced_sample(label_boolean(spark, sf), "doc_id", SEED)
    return fo.nested_folds(sample, OUTER, INNER, only)


@query(
    "nested_stratified_folds",
    f"""WITH {_POST_LABELS}, {sample_sql('post_labels')}
        SELECT doc_id, label, outer_fold, inner_fold FROM folds""",
)
def nested_stratified_folds(spark, sf):
    return post_folds(spark, sf)


@query(
    "fold_training_ids",
    f"""WITH {_POST_LABELS}, {sample_sql('post_labels')}
        SELECT doc_id, 'train' AS part FROM folds
        WHERE outer_fold = 0 AND inner_fold IS NOT NULL AND inner_fold <> 1
        UNION ALL SELECT doc_id, 'valid' FROM folds WHERE outer_fold = 0 AND inner_fold = 1
        UNION ALL SELECT doc_id, 'test' FROM folds WHERE outer_fold = 0 AND inner_fold IS NULL""",
)
def fold_training_ids(spark, sf):
    folds = post_folds(spark, sf, only=0)
    train, valid = fo.split_ids(folds, 0, 1)
    _, test = fo.split_ids(folds, 0, "all")
    parts = {"train": train, "valid": valid, "test": test}
    named = [df.select("doc_id", F.lit(n).alias("part")) for n, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "sample_restrict",
    f"""WITH {TAGGED_SQL}, {_POST_LABELS}, {sample_sql('post_labels')}
        SELECT f.doc_id AS id, t.tags FROM (SELECT doc_id FROM folds WHERE outer_fold = 0) f
        LEFT JOIN tagged t ON t.id = f.doc_id""",
)
def sample_restrict(spark, sf):
    ids = fo.sampled_ids(post_folds(spark, sf, only=0), 0, "doc_id")
    return fo.restrict(tagged(spark, sf), ids.withColumnRenamed("doc_id", "id"), "id")


# -- grids, sized by the folds of the posts -----------------------------------

_FOLD_SIZES_SQL = f"""{_POST_LABELS}, {sample_sql('post_labels')},
  inner0 AS (SELECT * FROM folds WHERE outer_fold = 0 AND inner_fold IS NOT NULL),
  sizes AS (SELECT inner_fold AS cv, count(*) AS n_valid,
    (SELECT count(*) FROM inner0) - count(*) AS n_train FROM inner0 GROUP BY inner_fold)"""


def _fold_sizes(spark, sf):
    inner0 = post_folds(spark, sf, only=0).filter(F.col("inner_fold").isNotNull())
    sizes = inner0.groupBy(F.col("inner_fold").alias("cv")).agg(F.count(F.lit(1)).alias("n_valid"))
    total = inner0.agg(F.count(F.lit(1))).scalar()
    return sizes.withColumn("n_train", total - F.col("n_valid"))


def _values(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({float(v)!r})' for v in values)}) {name}({name})"


def _learner_sql(grid) -> str:
    """Union of the kernels' parameter products; unused parameters read 1."""
    p = grid["params"]
    cost, gamma = _values("cost", p["cost"]), _values("gamma", p["gamma"])
    coef0, degree = _values("coef0", p["coef0"]), _values("degree", p["degree"])
    return f"""
      SELECT 'linear' AS kernel, cost, 1.0 AS gamma, 1.0 AS degree, 1.0 AS coef0 FROM {cost}
      UNION ALL SELECT 'rbf', cost, gamma, 1.0, 1.0 FROM {cost}, {gamma}
      UNION ALL SELECT 'sigmoid', cost, gamma, 1.0, coef0 FROM {cost}, {gamma}, {coef0}
      UNION ALL SELECT 'poly', cost, gamma, degree, coef0
        FROM {cost}, {gamma}, {degree}, {coef0}"""


def _sized(grid, spark, sf):
    return grid.join(_fold_sizes(spark, sf), "cv")


def _learner_query(name: str, grid):
    sql = f"""WITH {_FOLD_SIZES_SQL}, g AS ({_learner_sql(grid)})
      SELECT kernel, CAST(cost AS DOUBLE) AS cost, CAST(gamma AS DOUBLE) AS gamma,
        CAST(degree AS DOUBLE) AS degree, CAST(coef0 AS DOUBLE) AS coef0,
        cv, n_train, n_valid FROM g, sizes"""

    @query(name, sql)
    def run(spark, sf):
        rows = gr.fill_learner_grid(gr.learner_grid(spark, grid, presets.DYNAMIC_FEATURES))
        columns = ("kernel", "cost", "gamma", "degree", "coef0", "cv", "n_train", "n_valid")
        return _sized(rows, spark, sf).select(*columns)

    return run


param_grid_small = _learner_query("param_grid_small", presets.GRID_SMALL)
param_grid_full = _learner_query("param_grid_full", presets.GRID_FULL)


@query(
    "dynamic_grid",
    f"""WITH {_FOLD_SIZES_SQL}, g(name, type, key) AS (VALUES
        ('hashtags', 'community', 'proj_community(hashtags)_weighted_weighted'),
        ('lda_hashtags', 'lda', 'proj_lda(lda_hashtags)_1.0_1.0_0.0_20.0'),
        ('full_text', 'lda', 'proj_lda(full_text)_1.0_1.0_0.0_20.0'))
      SELECT name, type, cv, key || '_cv(' || cv || ')' AS feature_key, n_train, n_valid
      FROM g, sizes""",
)
def dynamic_grid(spark, sf):
    grid = gr.dynamic_grid(spark, presets.GRID_FULL, presets.DYNAMIC_FEATURES)
    fixed = ("row_id", "cv", "name", "type")
    values = [F.col(f"`{c}`").cast("string") for c in grid.columns if c not in fixed]
    key = store.feature_key_column("proj", F.col("type"), F.col("name"), values, F.col("cv"))
    rows = grid.select("name", "type", "cv", key.alias("feature_key"))
    return _sized(rows, spark, sf)


@query(
    "grid_shard",
    f"""WITH {_FOLD_SIZES_SQL}, g(i, name) AS (VALUES
        (0, 'hashtags'), (1, 'lda_hashtags'), (2, 'full_text')),
      r AS (SELECT i * {INNER} + cv AS row_id, name, cv, n_train FROM g, sizes)
      SELECT row_id, name, cv, n_train FROM r WHERE row_id >= 1 AND (row_id - 1) % 3 = 0""",
)
def grid_shard(spark, sf):
    grid = gr.dynamic_grid(spark, presets.GRID_FULL, presets.DYNAMIC_FEATURES)
    rows = gr.shard(grid, 1, 3).select("row_id", "name", "cv")
    return _sized(rows, spark, sf).select("row_id", "name", "cv", "n_train")


@query(
    "experiment_sizes",
    f"""WITH {LABELLED_SQL} SELECT
        'proj_test_svm_fffs_age_lda(lda_hashtags)_community(hashtags)' AS experiment,
        label, count(*) AS posts FROM labelled GROUP BY label""",
)
def experiment_sizes(spark, sf):
    key = store.experiment_key(
        "proj", "test", "svm", ["fffs", "age"], {"lda_hashtags": "lda", "hashtags": "community"}
    )
    counts = labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("posts"))
    return counts.select(F.lit(key).alias("experiment"), "label", "posts")
