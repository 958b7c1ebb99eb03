from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postweave.operators.folds import balanced_sample, nested_folds, sampled_ids, split_ids
from postweave.operators.prepare import label_table
from postweave.operators.ranking import hash_rank


def _labels(spark, rows=1000):
    # One class holds most of the rows.
    return spark.range(rows).select("id", (F.col("id") % 10 > 7).alias("label"))


def test_balanced_classes_and_repeatable(spark):
    labels = _labels(spark)
    first = balanced_sample(labels, "id", 7)
    assert Counter(r.label for r in first.collect()) == {True: 200, False: 200}
    again = balanced_sample(labels.repartition(7), "id", 7)
    assert {r.id for r in first.collect()} == {r.id for r in again.collect()}
    other = balanced_sample(labels, "id", 8)
    assert {r.id for r in first.collect()} != {r.id for r in other.collect()}


def test_nested_folds_partition_the_sample(spark):
    sample = balanced_sample(_labels(spark, 870), "id", 1)
    ids = {r.id for r in sample.collect()}
    folds = defaultdict(set)
    sizes = Counter()
    for r in nested_folds(sample, 5, 4).collect():
        folds[r.outer_fold, r.inner_fold].add(r.id)
        sizes[r.outer_fold, r.inner_fold, r.label] += 1
    for outer in range(5):
        parts = [folds[outer, i] for i in (None, 0, 1, 2, 3)]
        assert sum(map(len, parts)) == len(ids) and set().union(*parts) == ids
        for label in (True, False):
            inner = [sizes[outer, i, label] for i in range(4)]
            assert max(inner) - min(inner) <= 1
    tests = [folds[o, None] for o in range(5)]
    assert set().union(*tests) == ids and sum(map(len, tests)) == len(ids)


def test_split_ids(spark):
    folds = nested_folds(balanced_sample(_labels(spark), "id", 1), 5, 5, only=0)
    train, valid = split_ids(folds, 0, 2)
    full, test = split_ids(folds, 0, "all")
    assert train.join(valid, "id").count() == 0
    assert train.count() + valid.count() == full.count()
    assert full.join(test, "id").count() == 0
    assert sampled_ids(folds, 0, "id").count() == full.count() + test.count()


def test_small_classes_and_one_class(spark):
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id long, label string")
    sample = balanced_sample(few, "id", 1)
    assert sample.count() == 2
    assert nested_folds(sample, 3, 2).count() == 6
    one = spark.range(4).select("id", F.lit(True).alias("label"))
    assert balanced_sample(one, "id", 1).count() == 4
    assert balanced_sample(one.filter("id < 0"), "id", 1).count() == 0


def test_rank_equals_row_number(spark):
    rows = spark.range(5000).select("id", F.lit("hot").alias("g"))
    ranked = hash_rank(rows, ["g"], "id", ":x")
    ordered = [r.id for r in ranked.orderBy("rank").collect()]
    expected = rows.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":x"))), "id")
    assert ordered == [r.id for r in expected.collect()]
    assert {r.group_rows for r in ranked.collect()} == {5000}


def test_missing_count_is_false(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 4)], "id long, n int")
    assert {r.id: r.label for r in label_table(df, "id", "n").collect()} == {
        1: False, 2: False, 3: True,
    }
