import random

import cases
import numpy as np
import xxhash
from pyspark.sql import functions as F

from postweave.llm import simhash
from postweave.llm.common import components


def plain_fingerprint(text):
    words = cases.WORD.findall(cases.lower(text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 0))] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups_of_every_row(spark):
    data = cases.rows()
    prints = [plain_fingerprint(t) for _, t, *_ in data]
    near = [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = plain_components(near, range(len(data)))
    big = 2**63
    least = {}
    for i, (d, *_) in enumerate(data):
        least[group[i]] = min(least.get(group[i], big), big if d is None else d)
    want = [(d, f"{prints[i]:016x}", None if least[group[i]] == big else least[group[i]]) for i, (d, *_) in enumerate(data)]
    got = simhash.groups(spark, cases.clashing(cases.documents(spark)))
    assert cases.tuples(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.groups(spark, cases.documents(spark, [])).count() == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    values = set(base) | {0, 2**64 - 1, 2**63}
    for b in base:
        for k in (1, 2, 2, 3):
            values.add(b ^ sum(1 << i for i in rng.sample(range(64), k)))
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    a, b, c = (cases.sentence(rng, 80) for _ in range(3))
    more = [(7, a), (7, b), (7, b), (None, a), (None, c), (None, c), (None, None), (7, b + " x")]
    data = [*cases.rows(), *[(i, t, "en", "s", 1) for i, t in more]]
    prints = [plain_fingerprint(t) for _, t, *_ in data]
    near = [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = plain_components(near, range(len(data)))
    least = {}
    for i, (d, *_) in enumerate(data):
        least[group[i]] = min(least.get(group[i], 2**63), 2**63 if d is None else d)
    docs = cases.clashing(cases.documents(spark, data))
    kept = simhash.first_of_groups(spark, docs)
    found = kept.select("doc_id", "text").collect()
    assert sorted(2**63 if r.doc_id is None else r.doc_id for r in found) == sorted(least.values())
    # One of each group: all texts that stay lie in different ones.
    places = {t: group[i] for i, (_, t, *_) in enumerate(data)}
    assert len({places[r.text] for r in found}) == len(found) == len(set(group.values()))
    assert kept.columns == docs.columns
    assert cases.tuples(simhash.first_of_groups(spark, docs), "doc_id", "text") == cases.tuples(kept, "doc_id", "text")
    assert simhash.first_of_groups(spark, cases.documents(spark, [])).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(200), 100 + rng.randrange(200)) for _ in range(120)]
    links += [(400, k) for k in range(401, 460)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    df = spark.createDataFrame([*links, (7, None), (None, None)], "a long, b long")
    got = {r.node: r.component for r in components(spark, df).collect()}
    assert got == plain_components([x for x in links if x[0] != x[1]], nodes)
    assert components(spark, df.filter(F.lit(False))).count() == 0
