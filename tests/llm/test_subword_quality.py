import random
import zlib

import cases
import numpy as np
import pyarrow as pa

from postweave.llm import subword_quality as sq
from postweave.llm.common import Staging


def made(n, seed=1):
    """Texts of which a third shouts, stutters or is broken up by marks."""
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        words = cases.sentence(rng, rng.randint(20, 200)).split()
        kind = i % 9
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 3:
            words = [words[0]] * 80
        elif kind == 6:
            words = [w + rng.choice(["***", "%%%"]) for w in words]
        out.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(kind % 3 != 0)))
    return out, labels


def test_held_out_accuracy(spark):
    data, labels = made(900)
    marks = spark.createDataFrame([(d, q) for d, q in labels if d % 2], "doc_id long, quality int")
    got = sq.scored(spark, cases.clashing(cases.documents(spark, data)), marks).collect()
    assert len(got) == len(data)
    truth = dict(labels)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in held}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    good = [r.score for r in held if truth[r.doc_id] == 1]
    bad = [r.score for r in held if truth[r.doc_id] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_awkward_rows(spark):
    data = cases.rows()
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(1, None), (None, 1), (5, 0), (5, 1), (9999, 1), (2, 7)], "doc_id long, quality int"
    )
    docs = cases.clashing(cases.documents(spark, data))
    got = sq.scored(spark, docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, *_ in data), key=repr)
    assert not any(r.held_out or r.score is None for r in got if r.doc_id is None)
    # Texts without words score alike, and so do equal texts.
    score = {}
    for r in got:
        text = next(t for d, t, *_ in data if d == r.doc_id)
        score.setdefault((r.doc_id, text), set()).add(r.score)
    assert len({s for (d, _), v in score.items() if d in (200, 201, 202) for s in v}) == 1
    assert len(score[5, data[5][1]]) == 1
    assert cases.tuples(sq.scored(spark, docs, labels), "doc_id", "score") == cases.tuples(
        sq.scored(spark, docs, labels), "doc_id", "score")


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sq.scored(spark, cases.documents(spark), none).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    assert sq.scored(spark, cases.documents(spark, []), none).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    data, labels = made(300)
    data += [(0, "again " * k, "en", "s", 1) for k in range(50)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = cases.documents(spark, data)

    def sizes(most):
        found = [k for r in sq.sample(Staging(spark), docs, marks, most).collect() for k in r.labels]
        return {k: found.count(k) for k in (0, 1)}

    assert sizes(30) == {0: 30, 1: 30}
    assert sum(sizes(1000).values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))


def test_shares_give_the_same_mean_as_scores():
    rng = random.Random(4)
    texts = [cases.sentence(rng, n) for n in (1, 2, 50, 300)] + ["", " \n", "a a a a b", "Ünder 中文", None, "x" * 3000]
    model = sq.Model.first()
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape)
    model.bias[:] = 0.25, -0.5
    want = []
    for buckets, shares in sq.shares_of(pa.array(texts)):
        out = shares @ model.vectors[buckets] @ model.weights + model.bias if len(buckets) else model.bias
        want.append(1 / (1 + np.exp(out[0] - out[1])))
        assert len(buckets) == 0 or abs(shares.sum() - 1) < 1e-9
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-6)
    # Each text alone scores as it does among others.
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(alone, want, atol=1e-6)


def test_n_grams_of_a_word():
    buckets, sizes, _ = sq.word_buckets(pa.array(["ab", "é", "abcdef"], pa.large_string()))
    # Bytes with two marks: the word itself, then n-grams of 3, 4 and 5.
    assert sizes.tolist() == [1 + 2 + 1, 1 + 2 + 1, 1 + 6 + 5 + 4]
    again, _, _ = sq.word_buckets(pa.array(["abcdef"], pa.large_string()))
    assert sorted(buckets[-16:]) == sorted(again) and len(set(again.tolist())) == 16
    assert sq.read(pa.array(["x x x", "y y"])).pairs.tolist() == [sq.read(pa.array(["z z"])).pairs[0]] * 3
