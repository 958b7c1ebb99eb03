import numpy as np
import pytest

from postweave.llm import near_vectors
from postweave.llm.hnsw import Graph, unit

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n string"


def vectors(seed=1):
    """Random vectors, a dense group, chains of near ones, copies and broken ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 16))
    x[100:220] = x[100] + 0.01 * rng.normal(size=(120, 16))
    for k in range(300, 330):
        x[k] = x[k - 1] + 0.1 * rng.normal(size=16)
    x[350:360] = x[349]
    x[360] = 3 * x[349]
    rows = [(i, v.astype(np.float32).tolist(), i % 3 if i < 240 else 1, i, None) for i, v in enumerate(x)]
    rows += [
        (500, None, 1, 0, ""), (501, [0.0] * 16, 1, 0, ""), (502, [float("nan")] * 16, 1, 0, ""),
        (503, [1.0, None] * 8, 1, 0, ""), (504, rows[349][1], None, 0, ""), (505, [1.0, 2.0], 1, 0, ""),
        (506, [], 1, 0, ""), (507, [float("inf")] * 16, 1, 0, ""), (None, rows[349][1], 1, 0, ""), (5, rows[5][1], 2, 0, ""),
    ]
    return rows


def plain(rows):
    good = [
        (i, r) for i, r in enumerate(rows)
        if r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])
    ]
    links = [0] * len(rows)
    root = [r[0] for r in rows]
    pairs = []
    for a, (i, r) in enumerate(good):
        for j, s in good[:a]:
            if r[2] == s[2] and len(r[1]) == len(s[1]):
                u, v = np.array(r[1], float), np.array(s[1], float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return sorted(((r[0], links[i], root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard", [8192, 40])
def test_links_and_components_equal_brute_force(spark, shard):
    rows = vectors()
    got = near_vectors.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), shard=shard).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == plain(rows)


def test_no_vectors(spark):
    assert near_vectors.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_one_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[700:1000] = x[700] + 0.02 * rng.normal(size=(300, 32))
    x[1000:1400] = x[:400] + 0.05 * rng.normal(size=(400, 32))
    x = unit(x)[rng.permutation(1500)]
    true = {tuple(p) for p in np.argwhere(x @ x.T >= 0.98)}
    graph = Graph.build(x)
    rows, nodes, beam, recall = graph.audited(x, 0.98, 16, 0.995, 256)
    found = set(zip(rows.tolist(), nodes.tolist(), strict=True))
    assert found <= {tuple(p) for p in np.argwhere(x @ x.T >= 0.98 - 1e-6)}
    assert recall >= 0.995 and len(found & true) >= 0.99 * len(true)
    ids, sims = graph.search(x[:50], 64)
    best = np.argsort(-(x[:50] @ x.T), axis=1)[:, :10]
    hits = sum(len(set(a[:10]) & set(b)) for a, b in zip(ids.tolist(), best.tolist(), strict=True))
    assert hits >= 0.9 * best.size
