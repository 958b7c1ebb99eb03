import math
import zlib
from collections import Counter

import cases
import numpy as np

from postweave.llm import interpolation as lm


def texts_of(data):
    out = []
    for d, t, *_ in data:
        tokens = [*cases.WORD.findall(cases.lower(t)), None]
        rest = -1 if d is None else zlib.crc32(str(d).encode()) % 7
        out.append((d, tokens, rest == 2, rest == 3))
    return out


def plain(data):
    """The same model, counted with dictionaries."""
    texts = texts_of(data)
    count, kept, pair, kept_pair = Counter(), Counter(), Counter(), Counter()
    for _, tokens, held, tuning in texts:
        for u, v in zip(["<b>", *tokens], tokens, strict=False):
            if not held:
                count[v] += 1
                pair[u, v] += 1
                if not tuning:
                    kept[v] += 1
                    kept_pair[u, v] += 1
    begin = sum(not h for _, _, h, _ in texts), sum(not h and not t for _, _, h, t in texts)
    n, n_kept = sum(count.values()), sum(kept.values())
    before = lambda u: begin[0] if u == "<b>" else count[u]
    before_kept = lambda u: begin[1] if u == "<b>" else kept[u]
    cells = Counter()
    share = len(kept) + 1
    step = lambda r: round(math.log2(r) * lm.STEPS) + 512 if r > 0 else 0
    for _, tokens, held, tuning in texts:
        if tuning and not held:
            for u, v in zip(["<b>", *tokens], tokens, strict=False):
                c = before_kept(u)
                b = math.frexp(c)[1] if c else 0
                two = step(kept_pair[u, v] / c * share) if c else 0
                cells[(b << 20) + (step(kept[v] * share / n_kept) << 10) + two] += 1
    weights = lm.learned(sorted(cells.items()))
    rows = []
    for d, tokens, held, _ in texts:
        base = sum(math.log10((count[v] + 1) / (n + len(count) + 1)) for v in tokens)
        score = 0.0
        for u, v in zip(["<b>", *tokens], tokens, strict=False):
            lam = weights[math.frexp(before(u))[1] if before(u) else 0]
            score += math.log10(lam[0] / (len(count) + 1) + lam[1] * count[v] / n + lam[2] * pair[u, v] / max(before(u), 1))
        rows.append((d, held, len(tokens), sum(count[v] > 0 for v in tokens), n, round(base, 6), round(score, 6)))
    return sorted(rows, key=repr)


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 3000)  # several ranges
    data = cases.rows()
    got = lm.scored(spark, cases.clashing(cases.documents(spark, data)).repartition(3)).collect()
    rows = [(*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(rows, key=repr) == plain(data)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base, score = lm.scored(spark, docs).filter("held_out").groupBy().sum("base_score", "score").first()
    assert score > base


def test_no_documents(spark):
    assert lm.scored(spark, cases.documents(spark, [])).count() == 0


def test_weights_and_coding():
    w = lm.learned([((5 << 20) + (512 << 10) + 0, 1000), ((9 << 20) + (100 << 10) + 900, 1000)])
    assert np.allclose(w.sum(axis=1), 1) and (w[1:] > 0).all() and w[0, 2] == 0
    assert w[9, 2] > 0.9 and w[5, 2] < 0.01 and np.allclose(w[6], w[5])
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    for top in (1, 255, 256, 70_000, 2**40):
        values = np.random.default_rng(2).integers(0, top, 100)
        assert (lm.unpack(lm.pack(values)) == values).all()
    assert (np.diff(lm.ranges(keys, 7)) >= 0).all()
