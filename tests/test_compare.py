import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.functions.mcnemar import _binomial_cdf_half
from postweave.operators import compare as cm
from postweave.operators import metrics as me

TRUE = "0000011111"
MODELS = {"m0": "0100011000", "m1": "0011011000", "m2": "0111010000"}


def _preds(spark, models=MODELS, true=TRUE):
    rows = [
        (name, i, p == "1", t == "1")
        for name, preds in models.items()
        for i, (p, t) in enumerate(zip(preds, true))
    ]
    return spark.createDataFrame(rows, "experiment string, id long, pred boolean, true boolean")


def test_golden_tables(spark):
    tables = {
        r.models: (r.both_right, r.only_b, r.only_a, r.both_wrong)
        for r in cm.pair_tables(cm.contingency(_preds(spark))).collect()
    }
    assert tables == {
        "m0 vs m1": (4, 1, 2, 3), "m0 vs m2": (3, 0, 3, 4), "m1 vs m2": (3, 0, 2, 5),
    }


def test_golden_statistics(spark):
    tables = cm.contingency(_preds(spark))
    chi = {(r.a, r.b): r.chi2 for r in cm.mcnemar(tables).collect()}
    assert chi["m0", "m1"] == 0
    assert chi["m0", "m2"] == pytest.approx(4 / 3)
    assert chi["m1", "m2"] == pytest.approx(0.5)
    assert chi["m1", "m1"] == 0
    p = {(r.a, r.b): r.p_value for r in cm.mcnemar(tables, exact=True).collect()}
    assert [p["m0", "m1"], p["m0", "m2"], p["m1", "m2"]] == pytest.approx([1, 0.25, 0.5])
    assert p["m0", "m0"] == 1
    tail = {(r.a, r.b): r.p_value for r in cm.mcnemar(tables).collect()}
    assert tail["m0", "m2"] == pytest.approx(0.248213, abs=1e-6)
    plain = {(r.a, r.b): r.chi2 for r in cm.mcnemar(tables, corrected=False).collect()}
    assert plain["m0", "m0"] is None and plain["m0", "m2"] == 3


def test_many_experiments_with_unique_patterns(spark):
    """50 experiments, posts that some of them lack, and two targets for some posts."""
    rng = np.random.default_rng(5)
    k, n = 50, 400
    right, there, target = rng.random((k, n)) < 0.6, rng.random((k, n)) < 0.97, rng.integers(0, 3, n)
    there[:10] = True
    own = np.tile(target, (k, 1))
    own[7, 5] = 9
    rows = [
        (f"e{e:02}", i, int(own[e, i]) if right[e, i] else -1, int(own[e, i]))
        for e in range(k) for i in range(n) if there[e, i]
    ]
    df = spark.createDataFrame(rows, "experiment string, id long, pred int, true int").repartition(3)
    tables = cm.contingency(df)
    plan = tables._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    got = {(r.a, r.b): r for r in tables.collect()}
    assert len(got) == k * k
    for a, b in ((0, 1), (1, 0), (7, 3), (20, 33), (12, 12), (7, 7)):
        both = there[a] & there[b]
        r = got[f"e{a:02}", f"e{b:02}"]
        want = [(both & x & y).sum() for x, y in (
            (right[a], right[b]), (~right[a], right[b]), (right[a], ~right[b]), (~right[a], ~right[b]))]
        assert [r.both_right, r.only_b, r.only_a, r.both_wrong] == want
        same = (own[a] == own[b])[both].all() and both.sum() == there[a].sum() == there[b].sum()
        assert r.same_targets == same
    by = cm.contingency(df.withColumn("metric", F.lit("m")).union(df.withColumn("metric", F.lit(None).cast("string"))), by=("metric",))
    assert by.filter("metric = 'm'").count() == k * k
    assert cm.contingency(df.filter("false")).count() == 0


def test_binomial_tail():
    from math import comb

    for n in (1, 5, 40, 333):
        for k in {0, 1, n // 3, n // 2, n - 1}:
            exact = sum(comb(n, i) for i in range(k + 1)) / 2**n
            assert _binomial_cdf_half(k, n) == pytest.approx(exact, rel=1e-9)
    assert _binomial_cdf_half(499_999, 1_000_000) == pytest.approx(0.5, abs=1e-3)


def test_different_targets_are_not_compared(spark):
    both = _preds(spark, {"m0": MODELS["m0"]}).unionByName(
        _preds(spark, {"m9": MODELS["m0"]}, true=TRUE[::-1])
    )
    p = {(r.a, r.b): r.p_value for r in cm.mcnemar(cm.contingency(both)).collect()}
    assert p["m0", "m9"] is None and p["m9", "m9"] == 1


def test_matrix_and_report(spark):
    matrix = cm.p_matrix(cm.mcnemar(cm.contingency(_preds(spark))), list(MODELS)).collect()
    assert {r.experiment: r[r.experiment] for r in matrix} == dict.fromkeys(MODELS, 1.0)
    one = spark.createDataFrame([("accuracy", 0.5, 1.0)], "metric string, accuracy double, c double")
    two = spark.createDataFrame([("accuracy", 0.7)], "metric string, accuracy double")
    report = {r.field: (r.e1, r.e2) for r in cm.experiment_report({"e1": one, "e2": two}, "accuracy").collect()}
    assert report == {"metric": ("accuracy", "accuracy"), "accuracy": ("0.5", "0.7"), "c": ("1.0", "-")}


def test_scores(spark):
    preds = _preds(spark).withColumn("pred", F.col("pred") & (F.col("experiment") != "m2"))
    scores = {r.experiment: r for r in me.cv_scores(preds, ["experiment"], ["false", "true"]).collect()}
    # m2 never predicts true: F1 of that class is 0.
    assert scores["m2"]["true"] == 0 and scores["m2"].accuracy == 0.5
    assert scores["m0"].accuracy == 0.6 and scores["m0"]["true"] == pytest.approx(0.5)
    best = me.best_parameters(
        me.cv_scores(preds, ["experiment"], ["false", "true"]), ["experiment"], ["accuracy", "true"]
    )
    assert {r.metric: r.experiment for r in best.collect()} == {"accuracy": "m0", "true": "m0"}
