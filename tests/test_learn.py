import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postweave.operators import folds as fo
from postweave.operators import matrix as mx
from postweave.operators import regress as rg
from postweave.operators import search as se
from postweave.operators import gibbs
from postweave.operators import topics as tp
from postweave.operators.dynamic_features import FEATURE_TYPES, fold_feature
from postweave.operators import dual, learners
from postweave.operators.learners import fit_classifier, kernel_of, predictions, prepare_training
from postweave.operators.sparse_rows import Gram, Kernel, Rows, Shape, scaled_rows, shape_of, stored_values


def test_scaling(spark):
    rows = [(1, 1.0, None, 5.0, None), (2, 3.0, 4.0, 5.0, None), (3, float("nan"), 8.0, 5.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    scaling = mx.fit_scaling(df, ["a", "b", "c", "d"])
    assert scaling.columns == ["a", "b", "c"]
    scaled = mx.apply_scaling(df, scaling).toPandas()
    assert scaled[["a", "b"]].mean().tolist() == pytest.approx([0, 0])
    assert scaled[["a", "b"]].std(ddof=0).tolist() == pytest.approx([1, 1])
    assert scaled["c"].tolist() == [0, 0, 0]


def _sparse(df, width):
    """(id, label, features) as sparse rows without any scaling."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: k.cast("int"))
    return df.select("id", "label", numbers.alias("columns"), vector_to_array("features").alias("values")), Shape(width, np.zeros(width))


def _circle(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    label = (x**2).sum(1) > 1.4
    rows = [(i, bool(y), [float(a), float(b)]) for i, ((a, b), y) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "id long, label boolean, x array<double>")
    return df.select("id", "label", array_to_vector("x").alias("features")).repartition(2)


def _dense_kernel(kernel, x, y):
    inner = x @ y.T
    if kernel.name == "rbf":
        gap = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * inner
        return np.exp(-kernel.gamma * gap)
    if kernel.name == "poly":
        return (kernel.gamma * inner + kernel.coef0) ** kernel.degree
    return np.tanh(kernel.gamma * inner + kernel.coef0) if kernel.name == "sigmoid" else inner


@pytest.mark.parametrize("name", ["linear", "rbf", "poly", "sigmoid"])
@pytest.mark.parametrize("width", [7, 600])
def test_kernels_of_shifted_sparse_rows(name, width):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, width)) * (rng.random((30, width)) < 0.2)
    x[4] = 0
    shift = rng.normal(size=width) * 0.1
    at = [np.flatnonzero(r) for r in x]
    rows = Rows(np.cumsum([len(a) for a in at]), np.concatenate(at), np.concatenate([r[a] for r, a in zip(x, at)]))
    kernel = Kernel(name, 0.05, 1.0, 2.0, Shape(width, shift))
    want = _dense_kernel(kernel, x - shift, x - shift)
    gram = Gram(kernel, rows)
    assert np.allclose([gram.column(i) for i in range(30)], want)
    assert np.allclose(gram.diagonal(), np.diag(want))
    weights = rng.normal(size=30)
    assert np.allclose(gram.combined(rows, weights), want @ weights)


def _plain_dual(values, y, cost, rounds=200_000):
    """Sequential pairs on a whole matrix of kernel values."""
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        up = ((y > 0) & (alpha < cost - 1e-9)) | ((y < 0) & (alpha > 1e-9))
        low = ((y > 0) & (alpha > 1e-9)) | ((y < 0) & (alpha < cost - 1e-9))
        score = y - f
        i, j = np.argmax(np.where(up, score, -np.inf)), np.argmin(np.where(low, score, np.inf))
        if score[i] - score[j] < 1e-6:
            break
        step = (score[i] - score[j]) / max(values[i, i] + values[j, j] - 2 * values[i, j], 1e-12)
        step = min(step, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        f += step * (values[i] - values[j])
    return alpha.sum() - (alpha * y) @ f / 2


@pytest.mark.parametrize("name", ["linear", "rbf", "poly"])
@pytest.mark.parametrize("cost", [0.1, 5.0])
def test_the_dual_value_equals_an_exact_solve(spark, name, cost, monkeypatch):
    # Blocks and working sets far smaller than the rows: many rounds.
    monkeypatch.setattr(dual, "BLOCK_ROWS", 50)
    df = _circle(spark, 180)
    rows, shape = _sparse(df, 2)
    training = prepare_training(rows, "id", shape)
    assert training.stored.count() >= 4
    params = {"kernel": name, "gamma": 0.5, "degree": 2.0}
    kernel = kernel_of(params, shape)
    found = dual.solve(training.blocks, training.parts, training.n_blocks, kernel, 0, 1, cost, working=40)
    assert found.converged and found.rounds > 0
    assert 0 <= found.gap <= 1e-3 * found.primal and found.breach <= dual.TOLERANCE
    data = df.collect()
    x, y = np.array([r.features.toArray() for r in data]), np.array([1.0 if r.label else -1.0 for r in data])
    assert found.dual == pytest.approx(_plain_dual(_dense_kernel(kernel, x, x), y, cost), rel=2e-3)
    # The multipliers are feasible, and the linear weights give both values again.
    state = [(np.frombuffer(r.y), np.frombuffer(r.alpha)) for r in found.state.collect()]
    y, alpha = (np.concatenate(v) for v in zip(*state))
    assert abs(y @ alpha) < 1e-8 * cost * len(y) and alpha.min() >= 0 and alpha.max() <= cost
    if name == "linear":
        w = dual.linear_weights(dual.support(training.blocks, found.state, training.parts), shape)
        y = np.array([1.0 if r.label else -1.0 for r in data])
        again = w @ w / 2 + cost * np.maximum(1 - y * (x @ w + found.offset), 0).sum()
        assert again == pytest.approx(found.primal, rel=1e-9)
        assert alpha.sum() - w @ w / 2 == pytest.approx(found.dual, rel=1e-9)
    training.release()


def test_kernel_separates_what_a_line_cannot(spark, monkeypatch):
    rows, shape = _sparse(_circle(spark), 2)

    def accuracy(params):
        model = fit_classifier(rows, "id", params, shape)
        assert model.converged
        found = predictions(model, rows, "id")
        return found.agg(F.avg((F.col("pred") == F.col("true")).cast("double"))).first()[0], found

    curved, found = accuracy({"kernel": "rbf", "cost": 10.0, "gamma": 0.5})
    assert curved > 0.97
    assert accuracy({"kernel": "linear", "cost": 1.0})[0] < 0.8
    # Vectors sent in chunks give the same predictions.
    monkeypatch.setattr(dual, "CHUNK", 7)
    again = accuracy({"kernel": "rbf", "cost": 10.0, "gamma": 0.5})[1]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))


def test_three_classes(spark):
    rows = [(i, "abc"[i % 3], [float(i % 3 == 0), float(i % 3 == 1)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, x array<double>").select(
        "id", "label", array_to_vector("x").alias("features")
    )
    rows, shape = _sparse(df, 2)
    found = predictions(fit_classifier(rows, "id", {"cost": 1.0}, shape), rows, "id")
    assert found.filter(F.col("pred") != F.col("true")).count() == 0


def test_search_and_final_models(spark):
    df = _circle(spark)
    features = df.select("id", F.col("features")).select(
        "id", *[vector_to_array("features")[i].alias(f"x{i}") for i in range(2)]
    )
    labels = df.select("id", "label")
    folds = fo.nested_folds(fo.balanced_sample(labels, "id", 1), 3, 2, only=0)
    grid = [
        {"kernel": k, "cost": 1.0, "gamma": 0.5, "cv": cv} for k in ("linear", "rbf") for cv in (0, 1)
    ]
    found = se.parameter_search(folds, features, labels, "id", grid)
    inner = folds.filter("inner_fold is not null").count()
    assert found.groupBy("kernel").count().collect()[0]["count"] == inner
    best = [{"metric": m, "kernel": "rbf", "cost": 1.0, "gamma": 0.5} for m in ("accuracy", "true")]
    tests = se.final_models(best, folds, features, labels, "id")
    outer = folds.filter("inner_fold is null").count()
    assert {r.metric: r["count"] for r in tests.groupBy("metric").count().collect()} == {
        "accuracy": outer, "true": outer,
    }


def test_nothing_is_learnt_from_validation_posts(spark):
    rows = [(i, "dog cat" if i < 8 else "secret cat", i % 2 == 0) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, label boolean")
    ids = df.select("id")
    train, valid = ids.filter("id < 8"), ids.filter("id >= 8")
    params = {"no_below": 1, "no_above": 1.0}
    prepared = FEATURE_TYPES["bow"].prepare(df, "id", ["text"])
    bow = fold_feature("bow", prepared, train, valid, "id", params).collect()
    assert {r.features.size for r in bow} == {2} and len(bow) == 12
    terms = FEATURE_TYPES["terms"].prepare(df, "id", ["text"])
    odds = fold_feature("terms", terms, train, valid, "id", params).collect()
    alone = {round(r.features[0], 9) for r in odds if r.id >= 8}
    assert len(alone) == 1


def test_topics(spark):
    docs = ["apple pear plum"] * 20 + ["bolt screw nail"] * 20
    df = spark.createDataFrame(
        [(i, d.split()) for i, d in enumerate(docs)], "id long, final_text array<string>"
    )
    fitted = tp.fit_topics(df, 2, seed=5)
    rows = tp.infer_topics(df, fitted).select(
        "id", tp.clean_weights(F.col("topic_weights"), 0.1).alias("w")
    ).collect()
    assert all(sum(r.w) == pytest.approx(1) and len(r.w) == 2 for r in rows)
    keywords = tp.topic_keywords(spark, fitted, 3)
    assert sorted(r.topic for r in keywords.collect()) == [1, 2]
    placed = tp.dominant_topics(tp.infer_topics(df, fitted), keywords)
    assert placed.count() == 40
    assert tp.top_per_group(placed, "dominant_topic", "contribution", "id", 3).count() <= 6


def test_planted_topics_are_found_whatever_the_partitions(spark):
    """Posts of two of three vocabularies: words of one share a topic, all draws repeat."""
    rng = np.random.default_rng(0)
    words = [[f"{g}{i}" for i in range(12)] for g in "abc"]
    rows = []
    for i in range(240):
        lead, other = rng.permutation(3)[:2]
        parts = [*rng.choice(words[lead], 16), *rng.choice(words[other], 4), "rare" + str(i)]
        rows.append((i, [str(w) for w in parts]))
    rows += [(300, None), (301, []), (302, [None, "unknown"])]
    df = spark.createDataFrame(rows, "id long, final_text array<string>")
    fitted = tp.fit_topics(df.repartition(3, "id"), 3, no_below=2, seed=3, gain=0.02)
    assert len(fitted.terms) == 36 and fitted.counts.sum() == 240 * 20
    best = {t: int(np.argmax(fitted.counts[i])) for i, t in enumerate(fitted.terms)}
    groups = [{best[w] for w in g} for g in words]
    assert [len(g) for g in groups] == [1, 1, 1] and len(set.union(*groups)) == 3
    totals = {r.term: r.n for r in tp.topic_terms(fitted).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert totals == {t: sum(r[1].count(t) for r in rows if r[1]) for t in fitted.terms}
    found = {r.id: r.topic_weights for r in tp.infer_topics(df, fitted).collect()}
    assert all(found[i] == [0, 0, 0] for i in (300, 301, 302))
    assert all(np.argmax(found[i]) == best[rows[i][1][0]] for i in range(240))
    apart = {r.id: r.topic_weights for r in tp.infer_topics(df.repartition(7), fitted).collect()}
    assert all(np.allclose(found[i], apart[i], atol=1e-9) for i in found)
    again = tp.fit_topics(df.repartition(3, "id"), 3, no_below=2, seed=3, gain=0.02)
    assert again.fits == pytest.approx(fitted.fits) and (again.counts == fitted.counts).all()


def test_digamma_and_shares_of_one_post():
    assert gibbs.digamma(np.array([1.0, 0.5, 1e-3, 40.0])) == pytest.approx(
        [-0.5772156649, -1.9635100260, -1000.5755719318, 3.6763273737], rel=1e-8
    )
    rng = np.random.default_rng(2)
    shares = rng.dirichlet(np.ones(30), 4).T
    alpha = np.array([0.1, 0.5, 1.0, 0.2])
    sizes = [3, 0, 30, 1]
    term = np.concatenate([rng.choice(30, k, replace=False) for k in sizes])
    n = rng.integers(1, 5, len(term))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    got = gibbs.post_shares(starts, term, n, shares, alpha)
    for i, size in enumerate(sizes):
        theta, at = np.full(4, 0.25), slice(starts[i], starts[i + 1])
        for _ in range(5000 if size else 0):
            p = theta * shares[term[at]]
            theta = alpha + (p / p.sum(1, keepdims=True) * n[at][:, None]).sum(0)
            theta /= theta.sum()
        assert got[i] == pytest.approx(theta if size else np.zeros(4), abs=1e-4)


def test_rule_that_ends_the_passes():
    rising = [-9 + 0.01 * i for i in range(20)]
    assert not gibbs.settled(rising[:9]) and not gibbs.settled(rising)
    assert gibbs.settled(rising, gain=0.06) and gibbs.settled([*rising, *[-8.8] * 10])


def test_topic_cleanup_edges(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2],), ([0.1, 0.1, 0.1],)], "w array<double>")
    rows = [r.x for r in df.select(tp.clean_weights(F.col("w"), 0.2).alias("x")).collect()]
    assert rows[0] == pytest.approx([0.625, 0.375, 0]) and rows[1] == [0, 0, 0]
    best = df.select(*tp.dominant(F.col("w"))).collect()
    assert [tuple(r) for r in best] == [(0, 0.5), (0, 0.1)]


def test_regressions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 2 * x[:, 0] - x[:, 1] + 1
    rows = [(float(a), float(b), float(t), bool(t > 1)) for (a, b), t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, y double, l boolean")
    table, r2 = rg.ols_coefficients(df, ["a", "b"], "y")
    found = {r.feature: r.coefficient for r in table.collect()}
    assert found == pytest.approx({"a": 2, "b": -1}) and r2 == pytest.approx(1)
    logit = {r.feature: r.coefficient for r in rg.logit_coefficients(df, ["a", "b"], "l").collect()}
    assert logit["a"] > 0 > logit["b"]
    # At the optimum the slope of the penalised loss vanishes.
    wide = rng.normal(size=(200, 2))
    rows = [(float(a), float(b), bool(t)) for (a, b), t in zip(wide, wide[:, 0] + rng.normal(size=200) > 0.3)]
    noisy = spark.createDataFrame(rows, "a double, b double, l boolean")
    found = {r.feature: r.coefficient for r in rg.logit_coefficients(noisy, ["a", "b"], "l", cost=0.5).collect()}
    w, t = np.array([found["a"], found["b"]]), np.array([r[2] for r in rows], float)
    free = np.linspace(-3, 3, 60_001)
    # The intercept balances the residuals; find it and look at the rest of the slope.
    p = 1 / (1 + np.exp(-(wide @ w)[:, None] - free[None, ::100]))
    near = free[::100][np.argmin(np.abs((p - t[:, None]).sum(0)))]
    p = 1 / (1 + np.exp(-(wide @ w)[:, None] - (near + np.linspace(-0.01, 0.01, 2001))[None, :]))
    p = p[:, np.argmin(np.abs((p - t[:, None]).sum(0)))]
    assert np.allclose(wide.T @ (p - t) + w / 0.5, 0, atol=1e-3)
    none, r2 = rg.ols_coefficients(df.filter("false"), ["a", "b"], "y")
    assert [r.coefficient for r in none.collect()] == [0, 0] and np.isnan(r2)
    assert [r.coefficient for r in rg.logit_coefficients(df.filter("false"), ["a"], "l").collect()] == [0]
    twice = df.withColumn("c", F.col("a"))
    both = {r.feature: r.coefficient for r in rg.ols_coefficients(twice, ["a", "b", "c"], "y")[0].collect()}
    assert both == pytest.approx({"a": 1, "b": -1, "c": 1})
    report = rg.coefficient_report({"one": table, "two": table}).collect()
    assert {r.feature: r.two for r in report} == pytest.approx({"a": 2, "b": -1})


def test_nothing_to_learn_from(spark):
    """No known term, no edge: features are zero, not an error."""
    df = spark.createDataFrame([(1, "a b", None), (2, "a c", "x")], "id long, text string, tags string")
    ids = df.select("id")
    words = FEATURE_TYPES["lda"].prepare(df, "id", ["text"])
    params = {
        "no_below": 9, "no_above": 1, "LDA_num_topics": 3, "LDA_topic_cutoff_threshold": 0,
    }
    topics = fold_feature("lda", words, ids, ids.filter("id < 0"), "id", params)
    assert {tuple(r.features) for r in topics.collect()} == {(0.0, 0.0, 0.0)}
    tags = FEATURE_TYPES["community"].prepare(df, "id", ["tags"])
    params = {"community_graph_type": "weighted", "community_feature_type": "betweeness"}
    found = fold_feature("community", tags, ids, ids.filter("id < 0"), "id", params)
    assert {tuple(r.features) for r in found.collect()} == {(0.0,)}


def _whole(row, shape):
    out = -shape.shift
    np.add.at(out, row["columns"], row["values"])
    return out


def test_a_vector_feature_reaches_a_classifier(spark):
    texts = {0: "dog cat fish", 1: "bolt nail screw"}
    rows = [(i, texts[i % 2], i % 2 == 1, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label boolean, n double")
    labels = df.select("id", "label")
    folds = fo.nested_folds(fo.balanced_sample(labels, "id", 1), 4, 2, only=0)
    train_ids, valid_ids = fo.split_ids(folds, 0, 0)
    prepared = FEATURE_TYPES["bow"].prepare(df, "id", ["text"])
    bow = fold_feature("bow", prepared, train_ids, valid_ids, "id", {"no_below": 1, "no_above": 1.0})
    table = df.select("id", "n", F.array(F.col("n"), F.lit(1.0)).alias("pair")).join(
        bow.withColumnRenamed("features", "bow.counts"), "id", "left"
    )
    matrix = se.fold_matrix(folds, table, labels, "id", 0, 0)
    x = np.array([_whole(r, matrix.shape) for r in matrix.train.collect()])
    assert x.shape[1] == 9 and np.allclose(x.mean(0), 0)
    assert all(np.isclose(v, 1) or np.isclose(v, 0) for v in x.std(0))
    model = fit_classifier(matrix.train, "id", {"cost": 1.0}, matrix.shape)
    found = predictions(model, matrix.valid, "id")
    assert found.count() and found.filter(F.col("pred") != F.col("true")).count() == 0


def test_wide_vectors_scale_in_one_plan(spark):
    wide = 50_000
    df = spark.range(6).select("id", F.col("id").alias("at"))
    df = df.withColumn("v", array_to_vector(F.transform(
        F.sequence(F.lit(1), F.lit(wide)), lambda k: F.when(k == F.col("at") + 1, 6.0).otherwise(0.0)
    )))
    df = df.withColumn("v", F.when(F.col("id") < 5, F.col("v")))
    scaling = mx.fit_vector_scaling(df, "v")
    assert len(scaling.mean) == wide and scaling.mean[0] == pytest.approx(6 / 5)
    parts = mx.fit_parts(df, ["v"])
    shape = shape_of(parts)
    rows = {r.id: r for r in scaled_rows(df, parts, ["id"]).collect()}
    assert [len(rows[i]["values"]) for i in range(5)] == [1] * 5
    scaled = {i: _whole(r, shape) for i, r in rows.items()}
    assert np.allclose(scaled[5], 0) and not scaled[0][5:].any()
    assert np.std([scaled[i][0] for i in range(6)]) == pytest.approx(1)


def test_scaled_rows_of_every_kind(spark):
    """Sparse and dense vectors, arrays, gaps and not-a-number against plain arrays."""
    rows = [
        (1, 2.0, Vectors.sparse(4, [1, 3], [1.0, 2.0]), [1.0, 0.0]),
        (2, None, Vectors.dense([0.0, 1.0, 5.0, 0.0]), None),
        (3, float("nan"), None, [3.0, 4.0]),
        (4, 6.0, Vectors.sparse(4, [], []), [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, ["id", "n", "v", "a"]).withColumn("a", F.col("a").cast("array<double>"))
    df = mx.as_vectors(df, ["a"]).withColumn("gone", F.lit(None).cast("double"))
    parts = mx.fit_parts(df, ["v", "gone", "n", "a"])
    assert [p.name for p in parts] == ["v", "n", "a"] and parts[-1].at == 5
    shape = shape_of(parts)
    got = np.array([_whole(r, shape) for r in scaled_rows(df, parts, ["id"]).orderBy("id").collect()])
    v = np.array([[0, 1, 0, 2], [0, 1, 5, 0], [np.nan] * 4, [0, 0, 0, 0]])
    whole = np.hstack([v, [[2], [np.nan], [np.nan], [6]], [[1, 0], [np.nan] * 2, [3, 4], [0, 0]]])
    filled = np.where(np.isnan(whole), np.nanmean(whole, axis=0), whole)
    std = filled.std(axis=0)
    assert np.allclose(got, (filled - filled.mean(axis=0)) / np.where(std > 0, std, 1))


def test_a_wide_sparse_matrix_is_learned_in_little_memory(spark):
    """20,000 posts over 100,000 terms: a dense matrix would have 16 GB."""
    width, n = 100_000, 20_000
    at = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(width // 2)).cast("int"))))
    label = F.col("id") % 2 == 1
    mark = F.when(label, F.lit(width - 1)).otherwise(F.lit(width - 2)).cast("int")
    places = F.concat(at, F.array(mark))
    rows = spark.range(n).select("id", label.alias("label"), places.alias("columns"), F.transform(places, lambda _: F.lit(1.0)).alias("values"))
    shape = Shape(width, np.r_[np.full(width - 2, 1e-4), 0.5, 0.5])
    model = fit_classifier(rows, "id", {"cost": 1.0}, shape)
    assert model.converged and model.models[0].gap <= 1e-3 * model.models[0].primal
    found = predictions(model, rows, "id")
    assert found.filter(F.col("pred") != F.col("true")).count() == 0


def test_missing_parameters_read_one(spark):
    rows, shape = _sparse(_circle(spark, 60), 2)
    for kernel in ("rbf", "sigmoid", "poly"):
        short = fit_classifier(rows, "id", {"kernel": kernel, "gamma": None}, shape)
        full = {"kernel": kernel, "cost": 1.0, "gamma": 1.0, "coef0": 1.0, "degree": 1.0}
        long = fit_classifier(rows, "id", full, shape)
        assert short.kernel.gamma == short.kernel.coef0 == short.kernel.degree == 1.0
        assert short.models[0].dual == pytest.approx(long.models[0].dual)
    assert not fit_classifier(rows, "id", {"kernel": "rbf", "cost": 5.0}, shape, max_rounds=0).converged
    with pytest.raises(ValueError):
        fit_classifier(rows, "id", {"cost": 0}, shape)
    with pytest.raises(ValueError):
        fit_classifier(rows, "id", {"kernel": "other"}, shape)


def test_one_class_and_no_rows(spark):
    rows, shape = _sparse(_circle(spark, 40), 2)
    one = rows.filter("label")
    assert {r.pred for r in predictions(fit_classifier(one, "id", {}, shape), rows, "id").collect()} == {True}
    none = fit_classifier(rows.filter("false"), "id", {}, shape)
    assert none.converged and {r.pred for r in none.predict(rows).collect()} == {None}


def test_a_narrow_linear_problem_needs_no_rounds_of_pairs(spark, monkeypatch):
    """Overlapping classes in many blocks: Newton steps alone meet all conditions."""
    monkeypatch.setattr(dual, "BLOCK_ROWS", 500)
    monkeypatch.setattr(dual, "_solved", lambda *_: pytest.fail("a working set was solved"))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 3)) * [3, 1, 1]
    label = x @ [0.3, 1, 0] + 2 * rng.normal(size=6000) > 0.3
    df = spark.createDataFrame([(i, bool(y), v.tolist()) for i, (v, y) in enumerate(zip(x, label))], "id long, label boolean, x array<double>")
    rows, shape = _sparse(df.select("id", "label", array_to_vector("x").alias("features")), 3)
    training = prepare_training(rows, "id", shape)
    assert training.n_blocks > 3
    found = dual.solve(training.blocks, training.parts, training.n_blocks, kernel_of({}, shape), 0, 1, 1.0)
    assert found.converged and found.breach <= dual.TOLERANCE and 0 <= found.gap <= 1e-3 * found.primal
    state = [(np.frombuffer(r.y), np.frombuffer(r.alpha)) for r in found.state.collect()]
    y, alpha = (np.concatenate(v) for v in zip(*state))
    assert abs(y @ alpha) < 1e-8 * len(y) and alpha.min() >= 0 and alpha.max() <= 1
    training.release()


@pytest.mark.parametrize("name", ["linear", "rbf"])
def test_equal_rows_are_solved_as_one(spark, monkeypatch, name):
    """Rows of few flags are one block whatever their number; a copy counts as a row."""
    monkeypatch.setattr(dual, "BLOCK_ROWS", 200)
    flags = [(k, [float(k & 1), float(k >> 1 & 1), float(k >> 2)]) for k in np.random.default_rng(3).integers(0, 8, 900).tolist()]
    label = [(k * 7 + i) % 11 > 5 for i, (k, _) in enumerate(flags)]
    df = spark.createDataFrame([(i, bool(y), v) for i, ((_, v), y) in enumerate(zip(flags, label))], "id long, label boolean, x array<double>")
    rows, shape = _sparse(df.select("id", "label", array_to_vector("x").alias("features")), 3)
    training = prepare_training(rows, "id", shape)
    assert training.n_blocks == 1 and training.sizes == [label.count(False), label.count(True)]
    kernel = kernel_of({"kernel": name, "gamma": 0.5}, shape)
    found = dual.solve(training.blocks, training.parts, training.n_blocks, kernel, 0, 1, 2.0)
    x, y = np.array([v for _, v in flags]), np.where(label, 1.0, -1.0)
    assert found.converged and found.dual == pytest.approx(_plain_dual(_dense_kernel(kernel, x, x), y, 2.0), rel=2e-3)
    training.release()


@pytest.mark.parametrize("params", [{"kernel": "linear"}, {"kernel": "rbf", "gamma": 0.3}, {"kernel": "sigmoid", "gamma": 0.1}])
def test_copies_count_in_many_blocks(spark, monkeypatch, params):
    monkeypatch.setattr(dual, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(6)
    x, times = rng.normal(size=(240, 2)), rng.integers(1, 4, 240)
    x, label = np.repeat(x, times, 0), np.repeat(x @ [1, 0.5] + rng.normal(size=240) > 0.2, times)
    df = spark.createDataFrame([(i, bool(y), v.tolist()) for i, (v, y) in enumerate(zip(x, label))], "id long, label boolean, x array<double>")
    rows, shape = _sparse(df.select("id", "label", array_to_vector("x").alias("features")), 2)
    training = prepare_training(rows, "id", shape)
    assert training.n_blocks >= 4 and sum(training.sizes) == len(x)
    assert training.stored.select(F.explode("copies")).groupBy().sum().first()[0] == len(x)
    model = fit_classifier(rows, "id", params, shape).models[0]
    values = _dense_kernel(kernel_of(params, shape), x, x)
    assert model.converged and model.dual == pytest.approx(_plain_dual(values, np.where(label, 1.0, -1.0), 1.0), rel=2e-3)
    training.release()


def test_folds_are_searched_at_once(spark, monkeypatch):
    """Two folds wait for each other: one after another would never meet."""
    from threading import Barrier

    meeting, fit = Barrier(2), se.fit_cells

    def both(*args, **more):
        meeting.wait(timeout=60)
        return fit(*args, **more)

    monkeypatch.setattr(se, "fit_cells", both)
    rows = [(i, i % 2 == 0, float(i % 2), [0, 1][i % 4 > 1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label boolean, x double, inner_fold int").withColumn("outer_fold", F.lit(0))
    found = se.parameter_search(df.drop("x"), df.select("id", "x"), df.select("id", "label"), "id", [{"kernel": "linear", "cv": cv} for cv in (0, 1)])
    assert {(r.cv, r.n) for r in found.filter(F.col("pred") == F.col("true")).groupBy("cv").agg(F.count("*").alias("n")).collect()} == {("0", 20), ("1", 20)}


def test_only_texts_in_folds_are_prepared(spark, tmp_path, monkeypatch):
    from postweave.plans import learn

    docs = [(i, "aaa bbb ccc"[: 3 + 4 * (i % 3)], "en", "web", 11) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    seen, kind = [], type(FEATURE_TYPES["terms"])
    prepare = kind.prepare
    monkeypatch.setattr(kind, "prepare", lambda self, df, *a: seen.append(df) or prepare(self, df, *a))
    folds, _, features = learn._learning_tables(spark, str(tmp_path), [0, 1])
    assert seen[0].count() == folds.select("doc_id").distinct().count() == 60
    assert [features[cv].count() for cv in (0, 1)] == [folds.filter("inner_fold IS NOT NULL").count()] * 2


def test_stored_values_are_as_long_as_the_post(spark):
    rows = [(1, Vectors.sparse(100_000, [7, 99_999], [2.0, 1.0])), (2, Vectors.dense([0.0, 3.0])), (3, None)]
    df = spark.createDataFrame(rows, ["id", "v"])
    got = {r.id: r.x for r in df.select("id", stored_values("v").alias("x")).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 3.0], 3: None}


def test_draws_one_by_one_and_as_counts_agree(monkeypatch):
    """Every word gets a topic, and both ways of drawing have the same means."""
    starts, term, n = np.array([0, 3, 4]), np.array([0, 1, 2, 1], "<i4"), np.array([4000, 3000, 1, 5000], "<i4")
    shares, alpha = np.array([[0.7, 0.1], [0.2, 0.3], [0.1, 0.6]]), np.array([1.0, 2.0])
    means = []
    for few in (0, 10_000):
        monkeypatch.setattr(gibbs, "FEW", few)
        drawn = [gibbs.draw(np.random.default_rng(k), 0.0, starts, term, n, shares, alpha, 2) for k in range(40)]
        assert all((t.sum(1) == [7001, 5000]).all() and (w.sum(1) == [4000, 8000, 1]).all() for t, w, _ in drawn)
        means.append(np.mean([w[0, 0] for _, w, _ in drawn]))
    assert means[0] == pytest.approx(means[1], rel=0.15)


@pytest.mark.parametrize("params", [{"kernel": "rbf", "gamma": 0.3}, {"kernel": "poly", "gamma": 0.5, "coef0": 2.0, "degree": 3.0}])
def test_a_mapped_kernel_is_solved_by_steps_on_all_rows(spark, monkeypatch, params):
    """Noise in many blocks: one or two working sets are left, the dual value is exact."""
    monkeypatch.setattr(dual, "BLOCK_ROWS", 100)
    sets, solved = [], dual._solved
    monkeypatch.setattr(dual, "_solved", lambda *a: sets.append(1) or solved(*a))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    label = (x**2).sum(1) + rng.normal(size=900) > 1.6
    df = spark.createDataFrame([(i, bool(y), v.tolist()) for i, (v, y) in enumerate(zip(x, label))], "id long, label boolean, x array<double>")
    rows, shape = _sparse(df.select("id", "label", array_to_vector("x").alias("features")), 2)
    model = fit_classifier(rows, "id", params, shape)
    assert model.converged and len(sets) <= 3
    kernel, y = kernel_of(params, shape), np.where(label, 1.0, -1.0)
    values = _dense_kernel(kernel, x, x)
    assert model.models[0].dual == pytest.approx(_plain_dual(values, y, 1.0), rel=2e-3)
    training = prepare_training(rows, "id", shape)
    mapped = dual.exact_map(training.blocks, kernel, 900, 1.0)
    numbers = mapped.numbers(mapped.base(x))
    assert mapped.width < 200 and np.abs(numbers @ numbers.T - values).max() <= max(1e-8, 1e-13 * values.max())
    training.release()


@pytest.mark.parametrize("most", [1024, 3])
@pytest.mark.parametrize("name", ["rbf", "sigmoid"])
def test_support_vectors_do_not_pass_the_driver(spark, monkeypatch, name, most):
    """With or without a map of the kernel, outputs equal the sum over the vectors, and a
    row is scored once."""
    from postweave.operators import maps

    monkeypatch.setattr(maps, "MOST", most)
    monkeypatch.setattr(dual, "CHUNK", 7)
    rng = np.random.default_rng(9)
    x, v, weight = rng.normal(size=(50, 2)), rng.normal(size=(40, 2)), rng.normal(size=40)
    kernel = Kernel(name, 0.5, 0.2, 1.0, Shape(2, np.array([0.1, 0.0])))
    frame = lambda a, **more: spark.createDataFrame([(*[float(m[i]) for m in more.values()], [0, 1], r.tolist()) for i, r in enumerate(a)], ", ".join([*[f"{m} double" for m in more], "columns array<int>, values array<double>"]))
    x[7] = 30.0
    vectors, rows = frame(v, weight=weight).repartition(3), frame(x, id=np.arange(50)).repartition(4)
    # One row is like none of the vectors.
    training = prepare_training(frame(v, id=np.arange(40)).withColumn("label", F.col("id") > 20), "id", kernel.shape)
    mapped = dual.exact_map(training.blocks, kernel, 50, 1.0)
    assert (mapped is None) == (name == "sigmoid" or most == 3)
    outputs = dual.outputs_of(vectors, kernel, mapped, checked=True)
    assert (outputs is None) == (mapped is None)
    model = learners.PairClassifier(["a", "b"], [learners.PairModel(0, 1, 0.25, outputs, vectors, 40, 0.0, 0.0, 0, True)], kernel)
    found = {int(r.id): r.scores[0] for r in model.scores(rows).collect()}
    want = _dense_kernel(kernel, x - kernel.shape.shift, v - kernel.shape.shift) @ weight + 0.25
    assert len(found) == 50 == model.scores(rows).count() and [found[i] for i in range(50)] == pytest.approx(want.tolist())
    if mapped is not None:
        six = learners.PairClassifier(list("abcd"), [learners.PairModel(0, 1, 0.25, outputs, None, 40, 0.0, 0.0, 0, True)] * 6, kernel)
        assert six.scores(rows)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    training.release()


def test_texts_of_the_keyword_query_are_prepared_once(spark, monkeypatch):
    from postweave.plans import learn

    calls = []
    words = spark.createDataFrame([(i, i % 2 == 0, ["a", "b", "c"][i % 3:] + ["d"]) for i in range(60)], "doc_id long, label boolean, final_text array<string>")
    monkeypatch.setattr(learn, "_train", lambda *_: calls.append(1) or words)
    rows = learn.topic_keyword_terms(spark, "").collect()
    assert len(calls) == 1 and {r.topic for r in rows} == set(range(1, learn.TOPICS + 1))
    assert all(r.words == r.known for r in rows)


def test_separable_rows_take_few_steps_per_hinge(spark, monkeypatch):
    monkeypatch.setattr(dual, "BLOCK_ROWS", 1000)
    passes, sums = [], dual.rounded_sums
    monkeypatch.setattr(dual, "rounded_sums", lambda *a: passes.append(a[2]) or sums(*a))
    place = F.array(F.lit(0).cast("int"), F.lit(1).cast("int"))
    values = F.array((F.col("id") % 2) * 2.2 - 0.7, F.lit(0.3))
    rows = spark.range(4000).select("id", (F.col("id") % 2 == 0).alias("label"), place.alias("columns"), values.alias("values"))
    model = fit_classifier(rows, "id", {"kernel": "rbf", "gamma": 0.5}, Shape(2, np.zeros(2)))
    assert model.converged and all(passes.count(bend) <= 27 for bend in passes if bend > 1e-3)
    assert predictions(model, rows, "id").filter(F.col("pred") != F.col("true")).count() == 0


def test_blocks_of_a_task_share_one_row_of_sums(spark, monkeypatch):
    df = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 3}", "all"]) for i in range(90)], "id long, final_text array<string>")
    terms = sorted({f"w{k}" for k in range(7)} | {"all"})
    state = gibbs.blocks(df.coalesce(1), terms, "final_text").collect()
    some = spark.createDataFrame([(k, *state[0][1:]) for k in range(5)], gibbs.STATE).coalesce(1)
    after = gibbs.one_pass(some, np.full((8, 3), 1 / 8), np.ones(3), 1, 0).collect()
    assert sorted(r.mark for r in after) == list(range(5))
    assert [len(r.cells) > 0 for r in after] == [False] * 4 + [True]
    assert sum(v for c, v in zip(after[-1].cells, after[-1].sums) if c >= 0) == 5 * 270


def test_weights_are_inferred_without_the_other_columns(spark):
    rows = [(i, "a long text", [f"w{i % 4}", f"w{i % 2}"]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, final_text array<string>")
    fitted = tp.fit_topics(df, 2, seed=1, iterations=3)
    whole, alone = tp.infer_topics(df, fitted), tp.infer_topics(df, fitted, keep=["id"])
    assert whole.columns == [*df.columns, "topic_weights"] and alone.columns == ["id", "topic_weights"]
    assert {r.id: r.topic_weights for r in whole.collect()} == {r.id: r.topic_weights for r in alone.collect()}
    assert tp.infer_topics(df, tp.TopicModel([], 2), keep=["id"]).columns == ["id", "topic_weights"]
