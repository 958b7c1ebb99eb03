"""Metrics, model comparison, stored results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.operators import compare as cm
from postweave.operators import metrics as me
from postweave.operators import tag_stats as ts
from postweave.plans.registry import query
from postweave.plans.views import BOTH_TAGGED_SQL, PREDS_SQL, both_tagged, preds, tag_rows_sql
from postweave.session import scratch_path, stage
from postweave.sources import store

MODELS = ["m_lang", "m_len", "m_mix", "m_mod"]
CLASSES = ["false", "true"]
METRICS = ["accuracy", *CLASSES]

_SCORES_SQL = f"""{PREDS_SQL},
  per_class AS (SELECT experiment, cls AS "class",
      count(*) FILTER (pred = "true" AND pred = cls) AS tp,
      count(*) FILTER (pred <> "true" AND pred = cls) AS fp,
      count(*) FILTER (pred <> "true" AND "true" = cls) AS fn
    FROM preds, (VALUES (true), (false)) c(cls) GROUP BY experiment, cls),
  f AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE
      2 / (1 / (tp / (tp + fp)) + 1 / (tp / (tp + fn))) END AS f1 FROM per_class),
  acc AS (SELECT experiment, avg(CASE WHEN pred = "true" THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM preds GROUP BY experiment),
  scores AS (SELECT a.experiment, round(y.f1, 9) AS "true", round(n.f1, 9) AS "false",
      round(a.accuracy, 9) AS accuracy FROM acc a
    JOIN f y ON y.experiment = a.experiment AND y."class"
    JOIN f n ON n.experiment = a.experiment AND NOT n."class")"""

_BEST_SQL = f"""{_SCORES_SQL}, best AS (
  SELECT metric, experiment, "true", "false", accuracy FROM (
    SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, experiment) AS rn FROM (
      SELECT 'accuracy' AS metric, accuracy AS value, * FROM scores
      UNION ALL SELECT 'true', "true", * FROM scores
      UNION ALL SELECT 'false', "false", * FROM scores)) WHERE rn = 1)"""


def _scores(spark, sf):
    scores = me.cv_scores(preds(spark, sf), ["experiment"], CLASSES)
    return scores.withColumns({c: F.round(c, 9) for c in METRICS})


@query(
    "fold_accuracy",
    f"""WITH {PREDS_SQL} SELECT experiment, cv, count(*) AS "rows",
        round(avg(CASE WHEN pred = "true" THEN 1.0 ELSE 0.0 END), 9) AS accuracy
      FROM preds GROUP BY experiment, cv""",
)
def fold_accuracy(spark, sf):
    found = me.accuracy(preds(spark, sf), "experiment", "cv")
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "f1_per_class",
    f"""WITH {_SCORES_SQL} SELECT experiment, "class", tp, fp, fn, round(f1, 9) AS f1 FROM f""",
)
def f1_per_class(spark, sf):
    return me.class_scores(preds(spark, sf), "experiment").withColumn("f1", F.round("f1", 9))


@query("cv_metrics_pooled", f"WITH {_SCORES_SQL} SELECT * FROM scores")
def cv_metrics_pooled(spark, sf):
    return _scores(spark, sf)


@query("best_params", f"WITH {_BEST_SQL} SELECT * FROM best")
def best_params(spark, sf):
    return me.best_parameters(_scores(spark, sf), ["experiment"], METRICS)


# -- McNemar ---------------------------------------------------------------------

_TABLES_SQL = f"""{PREDS_SQL}, hit AS (
    SELECT experiment, id, pred = "true" AS ok, "true" AS target FROM preds),
  tables AS (SELECT x.experiment AS a, y.experiment AS b,
      count(*) FILTER (x.ok AND y.ok) AS both_right,
      count(*) FILTER (NOT x.ok AND y.ok) AS only_b,
      count(*) FILTER (x.ok AND NOT y.ok) AS only_a,
      count(*) FILTER (NOT x.ok AND NOT y.ok) AS both_wrong,
      bool_and(x.target = y.target) AS same_targets
    FROM hit x JOIN hit y USING (id) GROUP BY 1, 2),
  chi AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE
      (abs(only_b - only_a) - 1.0) ** 2 / (only_a + only_b) END AS chi2 FROM tables),
  tests AS (SELECT *, CASE WHEN chi2 = 0 THEN 1.0 WHEN chi2 > 80 THEN 0.0
      ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda i:
        exp(i * ln(2) + (2 * i + 1) * ln(sqrt(chi2 / 2)) - chi2 / 2
          - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1))))) END AS p_value FROM chi)"""


def _tables(spark, sf):
    return cm.contingency(preds(spark, sf))


@query("mcnemar_tables", f"WITH {_TABLES_SQL} SELECT * FROM tables")
def mcnemar_tables(spark, sf):
    return _tables(spark, sf)


@query(
    "mcnemar_pair_tables",
    f"""WITH {_TABLES_SQL} SELECT a || ' vs ' || b AS models, both_right, only_b, only_a,
          both_wrong FROM tables WHERE a < b""",
)
def mcnemar_pair_tables(spark, sf):
    return cm.pair_tables(_tables(spark, sf)).drop("a", "b", "same_targets")


@query(
    "mcnemar_tests",
    f"""WITH {_TABLES_SQL} SELECT a, b, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value
        FROM tests""",
)
def mcnemar_tests(spark, sf):
    tests = cm.mcnemar(_tables(spark, sf))
    return tests.select("a", "b", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"))


@query(
    "mcnemar_uncorrected",
    f"""WITH {_TABLES_SQL} SELECT a, b, CASE WHEN only_a + only_b > 0 THEN
          round((only_b - only_a) ** 2 / (only_a + only_b), 6) END AS chi2 FROM tables""",
)
def mcnemar_uncorrected(spark, sf):
    tests = cm.mcnemar(_tables(spark, sf), corrected=False)
    return tests.select("a", "b", F.round("chi2", 6).alias("chi2"))


@query(
    "mcnemar_exact",
    f"""WITH {_TABLES_SQL}, x AS (SELECT *, only_a + only_b AS n,
          least(only_a, only_b) AS k FROM tables)
        SELECT a, b, round(least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i:
          exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p_value
        FROM x""",
)
def mcnemar_exact(spark, sf):
    tests = cm.mcnemar(_tables(spark, sf), exact=True)
    return tests.select("a", "b", F.round("p_value", 6).alias("p_value"))


_CELLS = ", ".join(f"max(CASE WHEN b = '{m}' THEN round(p_value, 6) END) AS {m}" for m in MODELS)


@query(
    "mcnemar_matrix",
    f"WITH {_TABLES_SQL} SELECT a AS experiment, {_CELLS} FROM tests GROUP BY a",
)
def mcnemar_matrix(spark, sf):
    matrix = cm.p_matrix(cm.mcnemar(_tables(spark, sf)), MODELS)
    return matrix.withColumns({m: F.round(m, 6) for m in MODELS})


@query(
    "mcnemar_target_check",
    f"""WITH {PREDS_SQL}, hit AS (SELECT experiment, id, pred = target AS ok, target FROM (
          SELECT experiment, id, pred,
            CASE WHEN experiment = 'm_mod' THEN NOT "true" ELSE "true" END AS target FROM preds)),
        t AS (SELECT x.experiment AS a, y.experiment AS b, bool_and(x.target = y.target) AS same,
            count(*) FILTER (x.ok AND NOT y.ok) AS only_a,
            count(*) FILTER (NOT x.ok AND y.ok) AS only_b
          FROM hit x JOIN hit y USING (id) GROUP BY 1, 2)
        SELECT a, b, CASE WHEN same THEN CASE WHEN only_a + only_b = 0 THEN 0.0
          ELSE round((abs(only_b - only_a) - 1.0) ** 2 / (only_a + only_b), 6) END END AS chi2
        FROM t""",
)
def mcnemar_target_check(spark, sf):
    """One experiment predicts another target than the rest: its comparisons are empty."""
    other = F.when(F.col("experiment") == "m_mod", ~F.col("true")).otherwise(F.col("true"))
    tests = cm.mcnemar(cm.contingency(preds(spark, sf).withColumn("true", other)))
    return tests.select("a", "b", F.round("chi2", 6).alias("chi2"))


# -- reports and stores ------------------------------------------------------------


@query(
    "experiment_report",
    f"""WITH {_SCORES_SQL}, t AS (SELECT experiment, 'accuracy' AS metric, experiment AS e,
            CAST(round(accuracy * 10000) AS INT) AS score FROM scores)
        SELECT 'metric' AS field, 'accuracy' AS m_len, 'accuracy' AS m_lang
        UNION ALL SELECT 'score', max(CASE WHEN e = 'm_len' THEN CAST(score AS VARCHAR) END),
          max(CASE WHEN e = 'm_lang' THEN CAST(score AS VARCHAR) END) FROM t
        UNION ALL SELECT 'degree', '-', '2'""",
)
def experiment_report(spark, sf):
    score = F.round(F.col("accuracy") * 10000).cast("int")
    rows = _scores(spark, sf).select("experiment", F.lit("accuracy").alias("metric"), score.alias("score"))
    one = rows.filter("experiment = 'm_len'").drop("experiment")
    two = rows.filter("experiment = 'm_lang'").drop("experiment").withColumn("degree", F.lit(2))
    return cm.experiment_report({"m_len": one, "m_lang": two}, "accuracy")


@query(
    "result_store",
    f"""WITH {_BEST_SQL} SELECT b.metric, b.experiment, p.id, p.pred, p."true", b.accuracy
        FROM best b JOIN preds p ON p.experiment = b.experiment""",
)
def result_store(spark, sf):
    """Predictions appended in two shards, scored from the store, best ones read back."""
    path = scratch_path(spark, "results")
    rows = preds(spark, sf)
    for shard in (0, 1):
        part = rows.filter(F.col("cv") % 2 == shard)
        store.append_table(part.withColumn("shard", F.lit(shard)), path, "shard", "experiment")
    stored = spark.read.parquet(path)
    scores = me.cv_scores(stored, ["experiment"], CLASSES)
    scores = scores.withColumns({c: F.round(c, 9) for c in METRICS})
    best_path = scratch_path(spark, "best")
    store.write_table(me.best_parameters(scores, ["experiment"], METRICS), best_path, "metric")
    best = spark.read.parquet(best_path).select("metric", "experiment", "accuracy")
    tests = best.join(stored, "experiment").select(
        "metric", "experiment", "id", "pred", "true", "accuracy"
    )
    test_path = scratch_path(spark, "test-predictions")
    store.write_table(tests, test_path, "metric")
    return spark.read.parquet(test_path)


@query(
    "report_store",
    f"""WITH {BOTH_TAGGED_SQL}, r AS ({tag_rows_sql('both_tagged', 'dataset')}),
          n AS (SELECT dataset, count(*) AS n FROM both_tagged GROUP BY dataset)
        SELECT dataset, tag, round(count(*) / any_value(n), 9) AS share
        FROM r JOIN n USING (dataset) GROUP BY dataset, tag""",
)
def report_store(spark, sf):
    """Tag shares written per dataset, then one dataset overwritten, then read."""
    path = scratch_path(spark, "shares")
    shares = stage(ts.tag_share(both_tagged(spark, sf), "tags", "dataset"), "shares")
    rows = shares.select("dataset", "tag", F.round("share", 9).alias("share"))
    store.write_table(rows, path, "dataset")
    store.write_table(rows.filter("dataset = 'pages'"), path, "dataset")
    return spark.read.parquet(path).select("dataset", "tag", "share")


@query(
    "p_value_store",
    f"""WITH {_TABLES_SQL}, m AS (SELECT * FROM (VALUES ('accuracy'), ('true'), ('false')) v(metric))
        SELECT metric, a AS experiment, {_CELLS} FROM tests, m GROUP BY metric, a""",
)
def p_value_store(spark, sf):
    """p-value matrices of every metric in one comparison, stored per metric."""
    metrics = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    rows = preds(spark, sf).select("*", metrics)
    tests = cm.mcnemar(cm.contingency(rows, by=("metric",)))
    matrix = cm.p_matrix(tests, MODELS, by=("metric",))
    path = scratch_path(spark, "p-values")
    store.write_table(matrix.withColumns({m: F.round(m, 6) for m in MODELS}), path, "metric")
    return spark.read.parquet(path).select("metric", "experiment", *MODELS)


COMPARED = ["m_lang", "m_len", "m_mix"]
_COMPARED = ", ".join(f"max(CASE WHEN b = '{m}' THEN round(p_value, 6) END) AS {m}" for m in COMPARED)
_NAMES = ", ".join(f"'{m}'" for m in COMPARED)


@query(
    "compare_stored",
    f"""WITH {_TABLES_SQL}, m AS (SELECT * FROM (VALUES ('accuracy'), ('true')) v(metric))
        SELECT metric, a AS experiment, {_COMPARED} FROM tests, m
        WHERE a IN ({_NAMES}) AND b IN ({_NAMES}) GROUP BY metric, a""",
)
def compare_stored(spark, sf):
    """Three of four stored experiments compared for two of three stored metrics."""
    path = scratch_path(spark, "predictions")
    metrics = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    store.write_table(preds(spark, sf).select("*", metrics), path, "metric", "experiment")
    found = cm.compare_stored(spark, path, scratch_path(spark, "p-values"), ["accuracy", "true"], COMPARED)
    return found.select("metric", "experiment", *[F.round(m, 6).alias(m) for m in COMPARED])


@query(
    "report_per_metric",
    f"""WITH {_SCORES_SQL}, s AS (
          SELECT experiment AS e, 'accuracy' AS metric, accuracy AS v FROM scores
          UNION ALL SELECT experiment, 'true', "true" FROM scores
          UNION ALL SELECT experiment, 'false', "false" FROM scores),
        t AS (SELECT e, metric, CAST(CAST(round(v * 10000) AS INT) AS VARCHAR) AS score FROM s),
        p AS (SELECT metric, max(CASE WHEN e = 'm_len' THEN score END) AS m_len,
          max(CASE WHEN e = 'm_lang' THEN score END) AS m_lang FROM t GROUP BY metric)
        SELECT metric, 'score' AS field, m_len, m_lang FROM p
        UNION ALL SELECT metric, 'metric', metric, metric FROM p
        UNION ALL SELECT metric, 'degree', '-', '2' FROM p""",
)
def report_per_metric(spark, sf):
    """Results of two experiments, each stored on its own, and their report by metric."""
    scores = stage(_scores(spark, sf), "scores")
    results = {}
    for name in ("m_len", "m_lang"):
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("p")
        own = scores.filter(F.col("experiment") == name).select(pairs)
        rows = own.select("p.metric", F.round(F.col("p.v") * 10000).cast("int").alias("score"))
        if name == "m_lang":
            rows = rows.withColumn("degree", F.lit(2))
        results[name] = scratch_path(spark, f"result-{name}")
        store.write_table(rows, results[name])
    found = cm.report_stored(spark, results, scratch_path(spark, "reports"), METRICS)
    return found.select("metric", "field", *results)
