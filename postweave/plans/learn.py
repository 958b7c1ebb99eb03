"""Feature matrices, topics, learners and regressions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from postweave.operators import folds as fo
from postweave.operators import matrix as mx
from postweave.operators import metrics as me
from postweave.operators import regress as rg
from postweave.operators import search as se
from postweave.operators import topics as tp
from postweave.operators.dictionary import prepare_text
from postweave.operators.dynamic_features import FEATURE_TYPES, fold_feature
from postweave.operators.experiment import FITS_AT_A_TIME
from postweave.operators.sparse_rows import stored_values
from postweave.operators.static_features import StaticFeature, static_features
from postweave.plans.graph import page_tags
from postweave.plans.prep import _POST_LABELS, label_boolean, post_folds
from postweave.plans.registry import query
from postweave.plans.text import NO_ABOVE, NO_BELOW, _TRAIN_SQL, _dictionary, _train
from postweave.plans.views import INNER, LABELLED_SQL, SEED, labelled, posts, sample_sql, table, texts
from postweave.session import scratch_path, stage
from postweave.sources import store

TOPICS = 5
# Passes of the topic queries end when five of them gain less per word.
TOPIC_GAIN = 0.05

# -- matrix -----------------------------------------------------------------------

_SPLIT_SQL = f"""{_POST_LABELS}, {sample_sql('post_labels')},
  part AS (SELECT doc_id, inner_fold = 1 AS held FROM folds
    WHERE outer_fold = 0 AND inner_fold IS NOT NULL),
  x AS (SELECT doc_id, held, CAST(n_chars AS DOUBLE) AS n_chars,
      CAST(quality AS DOUBLE) AS engagement, CAST(length(lang) AS DOUBLE) AS flat
    FROM part JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))"""


def _raw_features(spark, sf):
    return posts(spark, sf).select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.col("engagement").cast("double").alias("engagement"),
        F.length("lang").cast("double").alias("flat"),
        F.lit(None).cast("double").alias("nothing"),
    )


def _z_sql(col: str) -> str:
    filled = f"coalesce({col}, (SELECT avg({col}) FROM x WHERE NOT held))"
    spread = (
        f"(SELECT stddev_pop(coalesce({col}, m)) FROM x, "
        f"(SELECT avg({col}) AS m FROM x WHERE NOT held) WHERE NOT held)"
    )
    return (
        f"round(({filled} - (SELECT avg({col}) FROM x WHERE NOT held)) / "
        f"(CASE WHEN {spread} > 0 THEN {spread} ELSE 1 END), 6) AS {col}"
    )


@query(
    "impute_scale",
    f"""WITH {_SPLIT_SQL} SELECT doc_id, held, {_z_sql('n_chars')}, {_z_sql('engagement')},
        {_z_sql('flat')} FROM x""",
)
def impute_scale(spark, sf):
    """A gap is filled, a column without values dropped, a constant one kept at 0."""
    train_ids, valid_ids = fo.split_ids(post_folds(spark, sf, only=0), 0, 1)
    features = _raw_features(spark, sf)
    train = mx.rows_for(train_ids, features, None, "doc_id")
    valid = mx.rows_for(valid_ids, features, None, "doc_id")
    columns = ["n_chars", "engagement", "flat", "nothing"]
    scaling = mx.fit_scaling(train, columns)
    both = train.withColumn("held", F.lit(False)).unionByName(
        valid.withColumn("held", F.lit(True))
    )
    scaled = mx.apply_scaling(both, scaling)
    return scaled.select("doc_id", "held", *[F.round(c, 6).alias(c) for c in scaling.columns])


@query(
    "feature_join",
    f"""WITH {_POST_LABELS}, {sample_sql('post_labels')}
        SELECT s.doc_id, s.label, CAST(n_chars AS DOUBLE) AS size,
          CAST(l.doc_id IS NOT NULL AS DOUBLE) AS judged, CAST(l.toxic AS DOUBLE) AS toxic
        FROM sample s LEFT JOIN documents d ON d.doc_id = s.doc_id
        LEFT JOIN labels l ON l.doc_id = s.doc_id""",
)
def feature_join(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    size = static_features(docs, "doc_id", {"size": StaticFeature({"n_chars": "numerical"})})
    judged = static_features(
        posts(spark, sf), "doc_id", {"judged": StaticFeature({"engagement": "boolean"})}
    )
    toxic = static_features(labels, "doc_id", {"toxic": StaticFeature({"toxic": "numerical"})})
    features = mx.join_features([size, judged, toxic], "doc_id")
    marks = label_boolean(spark, sf)
    sample = fo.balanced_sample(marks, "doc_id", SEED)
    return mx.rows_for(sample, features, marks, "doc_id").select(
        "doc_id", "label", "size", "judged", "toxic"
    )


@query(
    "feature_store_join",
    f"""WITH {_POST_LABELS}, {sample_sql('post_labels')}
        SELECT doc_id, inner_fold = 1 AS held, CAST(n_chars AS DOUBLE) AS f_0,
          CAST(length(lang) AS DOUBLE) AS f_1, CAST(length(source) AS DOUBLE) AS size
        FROM folds JOIN documents USING (doc_id)
        WHERE outer_fold = 0 AND inner_fold IS NOT NULL""",
)
def feature_store_join(spark, sf):
    """A fitted feature stored under its keys, one fold read back and joined."""
    docs = table(spark, sf, "documents")
    folds = post_folds(spark, sf, only=0)
    values = F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double"))
    fitted = docs.select("doc_id", values.alias("features"))
    root = scratch_path(spark, "features")
    keys = {}
    for cv in (0, 1):
        train_ids, valid_ids = fo.split_ids(folds, 0, cv)
        ids = train_ids.select("doc_id", F.lit(False).alias("held")).unionByName(
            valid_ids.select("doc_id", F.lit(True).alias("held"))
        )
        params = {"no_below": 10, "no_above": 0.5}
        keys[cv] = store.feature_key("proj", "bow", "bow_text", params, cv)
        rows = fitted.join(ids, "doc_id", "right")
        store.write_feature(rows, root, "bow_text", keys[cv], cv)
    read = store.read_feature(spark, root, "bow_text", keys[1], 1)
    static = static_features(docs, "doc_id", {"size": StaticFeature({"source": "length"})})
    wide = se.spread_array(read, "f", 2)
    return static.join(wide, "doc_id", "right").select("doc_id", "held", "f_0", "f_1", "size")


# -- arrays and topics --------------------------------------------------------------

_WEIGHTS_SQL = """w AS (SELECT vec_id, list_transform(embedding,
    lambda v: CAST(abs(v) AS DOUBLE)) AS weights FROM embeddings)"""


def _weights(spark, sf):
    weights = F.transform("embedding", lambda v: F.abs(v).cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", weights.alias("weights"))


@query(
    "argmax_array",
    f"""WITH {_WEIGHTS_SQL} SELECT vec_id,
          list_position(weights, list_max(weights)) - 1 AS topic,
          round_even(list_max(weights), 4) AS contribution FROM w""",
)
def argmax_array(spark, sf):
    position, weight = tp.dominant(F.col("weights"))
    return _weights(spark, sf).select(
        "vec_id", position.alias("topic"), weight.alias("contribution")
    )


@query(
    "topic_row_cleanup",
    f"""WITH {_WEIGHTS_SQL}, k AS (SELECT vec_id, list_transform(weights,
            lambda v: CASE WHEN v > 0.1 THEN v ELSE 0 END) AS kept FROM w)
        SELECT vec_id, place - 1 AS place, round(CASE WHEN list_sum(kept) = 0 THEN 0
          ELSE kept[place] / list_sum(kept) END, 6) AS weight
        FROM k, range(1, len(kept) + 1) r(place)""",
)
def topic_row_cleanup(spark, sf):
    cleaned = tp.clean_weights(F.col("weights"), 0.1)
    each = _weights(spark, sf).select("vec_id", F.posexplode(cleaned).alias("place", "weight"))
    return each.withColumn("weight", F.round("weight", 6))


@query(
    "topn_per_group",
    """WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (
         PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents)
       SELECT * FROM r WHERE place <= 20""",
)
def topn_per_group(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return tp.top_per_group(docs, "lang", "n_chars", "doc_id", 20)


def _topic_model(spark, sf, *more):
    """The stored terms of all posts, with the columns ``more``, and their model."""
    rows = prepare_text(texts(spark, sf), "doc_id", ["text"])
    train = stage(rows.select("doc_id", *more, "final_text"), "tokens")
    return train, tp.fit_topics(train, TOPICS, 2, 0.5, seed=SEED, gain=TOPIC_GAIN)


@query("topic_features")
def topic_features(spark, sf):
    train, fitted = _topic_model(spark, sf)
    weights = tp.clean_weights(F.col("topic_weights"), 0.1)
    return tp.infer_topics(train, fitted, keep=["doc_id"]).select("doc_id", weights.alias("features"))


@query("topic_keywords")
def topic_keywords(spark, sf):
    _, fitted = _topic_model(spark, sf)
    path = scratch_path(spark, "keywords")
    store.write_table(tp.topic_keywords(spark, fitted), path)
    return spark.read.parquet(path)


@query("topic_top_samples")
def topic_top_samples(spark, sf):
    train, fitted = _topic_model(spark, sf, "cleaned_text")
    placed = tp.dominant_topics(tp.infer_topics(train, fitted), tp.topic_keywords(spark, fitted))
    path = scratch_path(spark, "dominant-topics")
    store.write_table(placed, path)
    stored = spark.read.parquet(path)
    top = tp.top_per_group(stored, "dominant_topic", "contribution", "doc_id", 20)
    return top.select("dominant_topic", "place", "doc_id", "contribution", "keywords", "cleaned_text")


def _plain_model(spark, sf):
    """A model of unstemmed words, whose dictionary SQL can state."""
    train = _train(spark, sf)
    return train, tp.fit_topics(train, TOPICS, NO_BELOW, NO_ABOVE, seed=SEED, gain=TOPIC_GAIN)


@query(
    "topic_term_totals",
    f"WITH {_TRAIN_SQL} SELECT term, count(*) AS n, true AS in_topics FROM tok GROUP BY term",
)
def topic_term_totals(spark, sf):
    """Every occurrence of a term lies in one of the topics."""
    _, fitted = _plain_model(spark, sf)
    return tp.topic_terms(fitted).groupBy("term").agg(
        F.sum("n").alias("n"), F.bool_and(F.col("topic").between(1, TOPICS)).alias("in_topics")
    )


@query(
    "topic_weight_totals",
    f"""WITH {_TRAIN_SQL} SELECT doc_id, {TOPICS} AS topics,
          CAST(doc_id IN (SELECT doc_id FROM tok) AS DOUBLE) AS total,
          CASE WHEN doc_id IN (SELECT doc_id FROM tok) THEN {TOPICS} ELSE 0 END AS positive FROM words""",
)
def topic_weight_totals(spark, sf):
    """Weights add up to 1, all above 0; to 0 in posts without a known term."""
    train, fitted = _plain_model(spark, sf)
    weights = F.col("topic_weights")
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return tp.infer_topics(train, fitted, keep=["doc_id"]).select(
        "doc_id", F.size(weights).alias("topics"), F.round(total, 6).alias("total"),
        F.size(F.filter(weights, lambda w: w > 0)).alias("positive"),
    )


@query(
    "topic_keyword_terms",
    f"""WITH {_TRAIN_SQL}, top AS (SELECT unnest(range(1, {TOPICS} + 1)) AS topic),
          size AS (SELECT least(10, count(*)) AS words FROM dict)
        SELECT topic, words, words AS known, true AS ordered FROM top, size""",
)
def topic_keyword_terms(spark, sf):
    """The keywords of a topic are terms, in the order of their counts there."""
    train, fitted = _plain_model(spark, sf)
    named = tp.topic_keywords(spark, fitted)
    each = named.select("topic", F.posexplode(F.split("keywords", ", ")).alias("place", "term"))
    # At most ten rows per topic.
    found = F.broadcast(each).join(tp.topic_terms(fitted), ["topic", "term"], "left")
    known = F.broadcast(each).join(_dictionary(train), "term").groupBy("topic").agg(
        F.count(F.lit(1)).alias("known")
    )
    ranked = found.groupBy("topic").agg(
        F.count(F.lit(1)).alias("words"),
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n")))).alias("p"),
    )
    falling = F.transform("p", lambda x: -x["n"])
    return ranked.join(known, "topic").select(
        "topic", "words", "known", (falling == F.array_sort(falling)).alias("ordered")
    )


# -- learners -------------------------------------------------------------------------


def _static(spark, sf):
    return static_features(
        posts(spark, sf),
        "doc_id",
        {
            "n_chars": StaticFeature({"n_chars": "numerical"}),
            "origin": StaticFeature({"lang": "length", "source": "length"}),
            "comma": StaticFeature({"text": "lookup"}, (",", "the", "The")),
        },
    )


def _learning_tables(spark, sf, cvs):
    """Stored folds and labels, and per fold the static features joined with the
    term odds fitted on that fold's training posts, some folds at once.

    Texts of posts that lie in no fold are not prepared: no fit reads them."""
    marks = stage(label_boolean(spark, sf), "labels")
    folds = stage(post_folds(spark, sf, only=0), "folds")
    docs = posts(spark, sf).join(marks, "doc_id").join(folds.select("doc_id"), "doc_id", "left_semi")
    prepared = stage(FEATURE_TYPES["terms"].prepare(docs, "doc_id", ["text"]), "tokens")
    static = stage(_static(spark, sf), "static")

    def of_fold(cv):
        train_ids, valid_ids = fo.split_ids(folds, 0, cv)
        odds = fold_feature(
            "terms", prepared, train_ids, valid_ids, "doc_id",
            # The odds span many orders of magnitude: their logarithm is used.
            {"no_below": 10, "no_above": 0.5, "logarithm": True},
        )
        odds = odds.withColumnRenamed("features", "terms")
        return stage(static.join(odds, "doc_id", "right"), "matrix")

    with ThreadPoolExecutor(FITS_AT_A_TIME) as pool:
        features = list(pool.map(inheritable_thread_target(spark)(of_fold), cvs))
    return folds, marks, dict(zip(cvs, features, strict=True))


def _search(spark, sf, grid, cvs):
    folds, marks, features = _learning_tables(spark, sf, cvs)
    rows = [{**g, "cv": cv} for g in grid for cv in cvs]
    return folds, marks, features, se.parameter_search(folds, features, marks, "doc_id", rows)


INNER_FOLDS = list(range(INNER))
LINEAR = {"kernel": "linear", "cost": 1.0}
KERNELS = [
    {"kernel": "rbf", "cost": 1.0, "gamma": 0.1},
    {"kernel": "poly", "cost": 1.0, "gamma": 0.1, "coef0": 10.0, "degree": 2.0},
    {"kernel": "sigmoid", "cost": 1.0, "gamma": 0.1, "coef0": 10.0},
]


@query("svm_linear")
def svm_linear(spark, sf):
    return _search(spark, sf, [LINEAR], INNER_FOLDS)[-1].select("doc_id", "pred", "true")


@query("svm_kernel")
def svm_kernel(spark, sf):
    return _search(spark, sf, KERNELS, INNER_FOLDS)[-1].select("kernel", "doc_id", "pred", "true")


@query("param_search")
def param_search(spark, sf):
    """Scores of a small grid, pooled over all inner folds."""
    found = _search(spark, sf, [LINEAR, KERNELS[0]], INNER_FOLDS)[-1]
    return me.cv_scores(found, list(se.PARAMS), ["false", "true"])


@query("final_model")
def final_model(spark, sf):
    """Search, best row per metric, refit on all inner folds, outer test predictions."""
    metrics = ["accuracy", "false", "true"]
    folds, marks, features, found = _search(
        spark, sf, [LINEAR, {**LINEAR, "cost": 0.01}], [*INNER_FOLDS, "all"]
    )
    scores = me.cv_scores(found.filter("cv <> 'all'"), list(se.PARAMS), ["false", "true"])
    best = me.best_parameters(scores, list(se.PARAMS), metrics).collect()
    preds = se.final_models(
        [r.asDict() for r in best], folds, features, marks, "doc_id"
    )
    return preds.select("metric", "kernel", "cost", "doc_id", "pred", "true")


@query("svm_multiclass")
def svm_multiclass(spark, sf):
    """Language from lengths and the first links of a document: one model per pair."""
    docs = table(spark, sf, "documents")
    marks = stage(docs.select("doc_id", F.col("lang").alias("label")), "labels")
    sample = fo.balanced_sample(marks, "doc_id", SEED)
    folds = stage(fo.nested_folds(sample, 5, 5, only=0), "folds")
    words = {
        name: StaticFeature({"text": "lookup"}, (word,))
        for name, word in {"en": "the", "fr": "les", "de": "der", "es": "los"}.items()
    }
    features = stage(static_features(docs, "doc_id", words), "static")
    found = se.parameter_search(
        folds, features, marks, "doc_id", [{**LINEAR, "cv": cv} for cv in INNER_FOLDS]
    )
    return found.select("doc_id", "pred", "true")


@query("fold_features_community")
def fold_features_community(spark, sf):
    """Communities of the training pages, features of training and validation pages."""
    pages = page_tags(spark, sf)
    marks = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.contains("url", F.lit("/en/")).alias("label")
    )
    folds = stage(fo.nested_folds(fo.balanced_sample(marks, "id", SEED), 5, 5, only=0), "folds")
    train_ids, valid_ids = fo.split_ids(folds, 0, 1)
    kind = FEATURE_TYPES["community"]
    prepared = kind.prepare(pages, "id", ["tags"])
    params = {"community_graph_type": "weighted", "community_feature_type": "weighted"}
    return fold_feature("community", prepared, train_ids, valid_ids, "id", params)


@query("fold_features_topics")
def fold_features_topics(spark, sf):
    """Topics of the training posts, weights of training and validation posts."""
    folds = stage(post_folds(spark, sf, only=0), "folds")
    train_ids, valid_ids = fo.split_ids(folds, 0, 1)
    kind = FEATURE_TYPES["lda"]
    prepared = stage(kind.prepare(texts(spark, sf), "doc_id", ["text"]), "tokens")
    params = {
        "no_below": 2, "no_above": 0.5, "LDA_topic_cutoff_threshold": 0.1,
        "LDA_num_topics": TOPICS, "seed": SEED, "gain": TOPIC_GAIN,
    }
    return fold_feature("lda", prepared, train_ids, valid_ids, "doc_id", params)


@query("fold_features_bow")
def fold_features_bow(spark, sf):
    """Term counts over the training dictionary: known tokens per post."""
    folds = stage(post_folds(spark, sf, only=0), "folds")
    train_ids, valid_ids = fo.split_ids(folds, 0, 1)
    kind = FEATURE_TYPES["bow"]
    prepared = stage(kind.prepare(texts(spark, sf), "doc_id", ["text"]), "tokens")
    params = {"no_below": 10, "no_above": 0.5}
    found = fold_feature("bow", prepared, train_ids, valid_ids, "doc_id", params)
    total = F.aggregate(stored_values("features"), F.lit(0.0), lambda acc, v: acc + v)
    return found.select("doc_id", total.alias("known_tokens"))


# -- regressions -------------------------------------------------------------------------


@query(
    "ols_single",
    """SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 4)
         AS coefficient, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
)
def ols_single(spark, sf):
    found, r2 = rg.ols_coefficients(
        table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"
    )
    return found.select(
        "feature", F.round("coefficient", 4).alias("coefficient"), F.round(F.lit(r2), 6).alias("r2")
    )


_FIT_SQL = f"""{LABELLED_SQL}, x AS (SELECT CAST(label AS INT) AS y,
    (n_chars - (SELECT avg(n_chars) FROM labelled)) /
      (SELECT stddev_pop(n_chars) FROM labelled) AS a,
    (length(lang || source) - (SELECT avg(length(lang || source)) FROM labelled)) /
      (SELECT stddev_pop(length(lang || source)) FROM labelled) AS b FROM labelled),
  s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
    covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM x)"""


def _scaled_posts(spark, sf):
    rows = labelled(spark, sf).select(
        "doc_id",
        F.col("label").cast("int").alias("label"),
        F.col("n_chars").cast("double").alias("chars"),
        F.length(F.concat("lang", "source")).cast("double").alias("origin"),
    )
    return mx.apply_scaling(rows, mx.fit_scaling(rows, ["chars", "origin"]))


@query(
    "ols_coefficients",
    f"""WITH {_FIT_SQL} SELECT 'chars' AS feature,
          round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) AS coefficient FROM s
        UNION ALL SELECT 'origin', round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) FROM s""",
)
def ols_coefficients(spark, sf):
    found, _ = rg.ols_coefficients(_scaled_posts(spark, sf), ["chars", "origin"], "label")
    return found.withColumn("coefficient", F.round("coefficient", 6))


# Newton steps from zero; the last ones change nothing any more.
_LOGIT_SQL = f"""{_FIT_SQL},
  steps AS (
    SELECT 0 AS it, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS z
    UNION ALL
    SELECT it + 1,
      u - (g1 * (e * f - d * d) - g2 * (b * f - c * d) + g3 * (b * d - c * e)) / det,
      v - (-g1 * (b * f - c * d) + g2 * (a * f - c * c) - g3 * (a * d - b * c)) / det,
      z - (g1 * (b * d - c * e) - g2 * (a * d - b * c) + g3 * (a * e - b * b)) / det
    FROM (SELECT *, a * (e * f - d * d) - b * (b * f - c * d) + c * (b * d - c * e) AS det FROM (
      SELECT it, u, v, z, sum(w * xa * xa) + 1 AS a, sum(w * xa * xb) AS b, sum(w * xa) AS c,
        sum(w * xb) AS d, sum(w * xb * xb) + 1 AS e, sum(w) AS f,
        sum((p - y) * xa) + u AS g1, sum((p - y) * xb) + v AS g2, sum(p - y) AS g3
      FROM (SELECT it, u, v, z, y, xa, xb, p, p * (1 - p) AS w FROM (
        SELECT it, u, v, z, y, x.a AS xa, x.b AS xb, 1 / (1 + exp(-(u * x.a + v * x.b + z))) AS p
        FROM steps, x WHERE it < 25)) GROUP BY it, u, v, z)))"""


@query(
    "logit_coefficients",
    f"""WITH RECURSIVE {_LOGIT_SQL} SELECT 'chars' AS feature, round(u, 5) AS coefficient
          FROM steps WHERE it = 25
        UNION ALL SELECT 'origin', round(v, 5) FROM steps WHERE it = 25""",
)
def logit_coefficients(spark, sf):
    found = rg.logit_coefficients(_scaled_posts(spark, sf), ["chars", "origin"], "label")
    return found.withColumn("coefficient", F.round("coefficient", 5))


@query(
    "coefficient_report",
    """WITH d AS (SELECT 'lineitem' AS dataset, l_quantity AS x, l_extendedprice AS y FROM lineitem
         UNION ALL SELECT 'part', p_size, p_retailprice FROM part)
       SELECT 'x' AS feature,
         round(regr_slope(y, x) FILTER (dataset = 'lineitem'), 4) AS lineitem,
         round(regr_slope(y, x) FILTER (dataset = 'part'), 4) AS part FROM d""",
)
def coefficient_report(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    parts = table(spark, sf, "part").select(
        F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")
    )
    fits = {
        name: rg.ols_coefficients(df, ["x"], "y")[0]
        for name, df in {"lineitem": lines, "part": parts}.items()
    }
    report = rg.coefficient_report(fits)
    rows = report.select("feature", *[F.round(n, 4).alias(n) for n in fits])
    path = scratch_path(spark, "coefficients")
    store.write_table(rows, path, csv=True)
    schema = "feature string, lineitem double, part double"
    return spark.read.option("header", True).schema(schema).csv(path)
