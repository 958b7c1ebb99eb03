import hashlib
import math

import cases
import pytest
from pyspark.sql import functions as F

from postweave.llm import mixing


def draw(doc_id, rate, seed=mixing.SEED):
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for j in range(1, parts + 1):
        text = f"{'null' if doc_id is None else doc_id}:{seed}:{j}"
        u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        r = rate / parts
        p = c = math.exp(-r)
        k = 0
        while c <= u:
            k += 1
            p *= r / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "s1": 3.0}, {}])
def test_copies_equal_a_plain_draw(spark, weights):
    docs = cases.clashing(cases.documents(spark))
    data = cases.rows()
    size = {}
    for _, t, _, s, _ in data:
        size[s] = size.get(s, 0) + len((t or "").encode()) + 1
    share = {s: math.sqrt(b) if weights is None else weights.get(s, 0.0) for s, b in size.items()}
    whole = sum(share.values())
    rate = {s: share[s] / whole * sum(size.values()) / size[s] if whole else 0.0 for s in size}
    want = [(d, s, k) for d, _, _, s, _ in data if d is not None for k in range(draw(d, rate[s]))]
    got = mixing.replicate(spark, docs, weights)
    assert cases.tuples(got.filter("doc_id is not null"), "doc_id", "source", "copy") == sorted(want, key=repr)
    kept = mixing.replicate(spark, docs, weights, keep=True)
    assert kept.select("row.*").columns == docs.columns and kept.count() == got.count()


def test_documents_without_id(spark):
    n = 1000
    data = [(None, f"text {k}", "en", "s", 1) for k in range(n)]
    got = mixing.replicate(spark, cases.documents(spark, data), keep=True)
    assert abs(got.count() - n) < 5 * math.sqrt(n)
    assert got.select("shuffle_key").distinct().count() == got.count()
    assert got.select("row.text", "copy").distinct().count() == got.count()


def test_large_rates_and_mean(spark):
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    for rate in (0.3, 4.0, 700.0):
        part = rate / math.ceil(rate / mixing.PART)
        parts = math.ceil(rate / mixing.PART)
        k = sum(
            (mixing.poisson(mixing.uniform(F.col("doc_id"), F.lit(1), F.lit(j)), F.lit(part)) for j in range(1, parts + 1)),
            F.lit(0),
        )
        mean = rows.agg(F.avg(k)).first()[0]
        assert abs(mean - rate) < 5 * math.sqrt(rate / n)


def test_no_documents(spark):
    assert mixing.replicate(spark, cases.documents(spark, [])).count() == 0
