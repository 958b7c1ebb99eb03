import random
from itertools import combinations

import pytest

from postweave.operators import centrality, communities, tag_graph
from postweave.operators.communities import (
    community_arrays,
    community_features,
    community_text,
    find_communities,
    membership,
    modularity,
    number_communities,
)
from postweave.operators.tag_stats import (
    count_summary,
    even_histogram,
    ranked_tags,
    tag_share,
    tags_per_post,
    unit_histogram,
)


def _posts(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id long, tags string")


GOLDEN = ["a, B", "b", None, "A,a,c"]


def test_share_and_edges_golden(spark):
    posts = _posts(spark, GOLDEN)
    shares = {r.tag: r.share for r in tag_share(posts, "tags").collect()}
    assert shares == {"a": 0.5, "b": 0.5, "c": 0.25, "": 0.25}
    top = ranked_tags(tag_share(posts, "tags"), 2).orderBy("rank").collect()
    assert [(r.tag, r["rank"]) for r in top] == [("b", 2), ("", 3)]
    edges = {(r.src, r.dst): r.weight for r in tag_graph.cooccurrence_edges(posts, "tags").collect()}
    assert edges == {("a", "b"): 1, ("a", "c"): 1}


def test_long_sets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(tag_graph, "BLOCK", 4)
    tags = [f"t{i:02d}" for i in range(19)]
    posts = _posts(spark, [",".join(tags), ",".join(tags), "t00,t01", None])
    edges = {(r.src, r.dst): r.weight for r in tag_graph.cooccurrence_edges(posts, "tags").collect()}
    expected = {pair: 2 for pair in combinations(tags, 2)}
    expected["t00", "t01"] = 3
    assert edges == expected


def test_copies_are_paired_once(spark):
    posts = _posts(spark, ["x,y"] * 500 + ["y,z"])
    edges = {(r.src, r.dst): r.weight for r in tag_graph.cooccurrence_edges(posts, "tags").collect()}
    assert edges == {("x", "y"): 500, ("y", "z"): 1}


def test_histograms(spark):
    freq = tags_per_post(_posts(spark, ["a", None, "a,b", "a,b,c", "a,b,c,d"]), "tags")
    unit = {r.bin: r.posts for r in unit_histogram(freq).collect()}
    # Edges 0, 1, 2, 3: the last bin [2, 3] is closed, the length 4 lies outside.
    assert unit == {1: 2, 2: 2}
    even = {r.bin: r.posts for r in even_histogram(freq).collect()}
    assert even == {0: 2, 1: 1, 2: 1, 3: 1}
    row = count_summary(freq).first()
    assert (row["mean"], row["median"], row["longest"]) == (2.2, 2.0, 4)
    same = tags_per_post(_posts(spark, ["a,b", "c,d"]), "tags")
    assert {r.bin: r.posts for r in even_histogram(same).collect()} == {1: 2}


CLIQUES = ["a1,a2,a3,a4"] * 3 + ["b1,b2,b3"] * 3 + ["a1,b1", "lone", None]


def test_planted_communities(spark):
    posts = _posts(spark, CLIQUES)
    edges = tag_graph.cooccurrence_edges(posts, "tags")
    member = find_communities(edges)
    found = {r.tag: r.community for r in membership(member).collect()}
    # Tags never paired are not in the graph; the larger community comes first.
    assert found == {**{f"a{i}": 0 for i in range(1, 5)}, **{f"b{i}": 1 for i in range(1, 4)}}
    score = modularity(edges, member).first()
    assert score.modularity > 0.4 > score.modularity_alone and score.communities == 2
    texts = {(r.community, r.part): r.members
             for r in community_text(membership(member), per_row=3).collect()}
    assert sorted(" ".join(v for k, v in texts.items() if k[0] == 0).split()) == ["a1", "a2", "a3", "a4"]
    assert len(texts) == 3


def _sequential(edges):
    """Modularity after moving one tag at a time, without merging."""
    near, degree = {}, {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    degree = {v: sum(n.values()) for v, n in near.items()}
    whole, own = sum(degree.values()), {v: v for v in near}

    def gain(v, c):
        inside = sum(w for u, w in near[v].items() if u != v and own[u] == c)
        return inside * whole - degree[v] * sum(degree[u] for u in near if own[u] == c and u != v)

    moved = True
    while moved:
        moved = False
        for v in sorted(near):
            best = max({own[u] for u in near[v]} | {own[v]}, key=lambda c: (gain(v, c), c))
            if gain(v, best) > gain(v, own[v]):
                own[v], moved = best, True
    return _modularity(edges, own)


def _modularity(edges, own):
    whole = 2 * sum(edges.values())
    degree, inside = {}, 0
    for (a, b), w in edges.items():
        degree[own[a]] = degree.get(own[a], 0) + w
        degree[own[b]] = degree.get(own[b], 0) + w
        inside += 2 * w * (own[a] == own[b])
    return inside / whole - sum((d / whole) ** 2 for d in degree.values())


def _random_edges(seed, groups=5, size=7):
    rng = random.Random(seed)
    tags = [f"t{i:02}" for i in range(groups * size)]
    out = {}
    for i, a in enumerate(tags):
        for b in tags[i + 1 :]:
            if rng.random() < (0.7 if i // size == tags.index(b) // size else 0.06):
                out[a, b] = rng.randint(1, 4)
    return out


def test_moves_raise_the_modularity_until_none_gains(spark, monkeypatch):
    edges = _random_edges(1, 3, 5)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight long")
    scores, real = [], communities._score

    def noted(state, total, turn):
        found = real(state, total, turn)
        scores.append(found[0])
        return found

    monkeypatch.setattr(communities, "_score", noted)
    whole = find_communities(df)
    own = {r.tag: r.label for r in whole.collect()}
    assert _modularity(edges, own) >= _sequential(edges) - 1e-9
    assert modularity(df, whole).first().modularity == pytest.approx(_modularity(edges, own))
    assert len(scores) > 2
    # A level alone is never better than all of them, and no tag gains by a move.
    one = {r.tag: r.label for r in find_communities(df, levels=1).collect()}
    assert _modularity(edges, own) >= _modularity(edges, one) - 1e-12
    for v in one:
        near = {one[b if a == v else a] for a, b in edges if v in (a, b)}
        for c in near:
            assert _modularity(edges, {**one, v: c}) <= _modularity(edges, one) + 1e-12
    # Looking at changed tags alone gives the same communities.
    monkeypatch.setattr(communities, "FRONTIER_LINKS", 10)
    assert {r.tag: r.label for r in find_communities(df).collect()} == own


def test_a_long_path_settles(spark):
    rows = [(f"p{i:03}", f"p{i + 1:03}", 1) for i in range(120)]
    edges = {(a, b): w for a, b, w in rows}
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    own = {r.tag: r.label for r in find_communities(df).collect()}
    assert _modularity(edges, own) > max(_sequential(edges), 0.8)


def test_numbering_by_size(spark):
    rows = [(f"t{i}", "big") for i in range(5)] + [(f"u{i}", f"s{i % 3}") for i in range(6)]
    numbered = number_communities(spark.createDataFrame(rows, "tag string, label string")).collect()
    assert sorted(r.community for r in numbered) == [0, 1, 2, 3]
    assert {r.label: r.community for r in numbered}["big"] == 0


def test_community_features(spark):
    posts = _posts(spark, ["A1, a2,a2,b1,zz", None])
    members = spark.createDataFrame(
        [("a1", 0), ("a2", 0), ("b1", 1)], "tag string, community int"
    )
    central = spark.createDataFrame([("a1", 0.5), ("a2", 0.25)], "tag string, centrality double")
    for kind, expected in {"binary": [1, 1], "weighted": [2, 1], "betweeness": [0.75, 0]}.items():
        long = community_features(posts, "id", "tags", members, kind, central)
        rows = community_arrays(posts.select("id"), long, "id", 2).collect()
        assert {r.id: r.features for r in rows} == {0: expected, 1: [0.0, 0.0]}
    with pytest.raises(ValueError):
        community_features(posts, "id", "tags", members, "other")


def _brute(edges, weighted):
    """Betweenness by listing every simple path."""
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w if weighted else 1
    nodes = sorted(near)
    score = dict.fromkeys(nodes, 0.0)

    def paths(path, cost, end):
        if path[-1] == end:
            yield cost, path
            return
        for v, w in near[path[-1]].items():
            if v not in path:
                yield from paths([*path, v], cost + w, end)

    for s in nodes:
        for t in nodes:
            if s == t:
                continue
            found = list(paths([s], 0, t))
            best = min((c for c, _ in found), default=None)
            short = [p for c, p in found if c == best]
            for p in short:
                for v in p[1:-1]:
                    score[v] += 1 / len(short)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


EDGES = {
    ("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 2, ("c", "d"): 3, ("d", "e"): 1,
    ("c", "e"): 4, ("e", "f"): 2, ("d", "f"): 3, ("x", "y"): 1,
}


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("state_rows", [10**9, 40])
def test_betweenness_equals_brute_force(spark, weighted, state_rows):
    rows = [(a, b, w) for (a, b), w in EDGES.items()]
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    got = {r.tag: r.centrality for r in centrality.betweenness(df, weighted, state_rows).collect()}
    assert got == pytest.approx(_brute(EDGES, weighted))
