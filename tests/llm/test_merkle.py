import hashlib
import random
import zlib

import cases
import pytest

from postweave.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in fields])


def plain_tree(nodes):
    """Root, and per leaf the list of (siblings before, siblings after)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 2 * 2 : place // 2 * 2 + 2]
            ways[i].append((run[: place % 2], run[place % 2 + 1 :]))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], ways


def plain_manifest(data):
    langs = {}
    for row in data:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(*row), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([leaf for *_, leaf, _ in sorted(langs[x], key=lambda r: r[:3])]) for x in order]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for lang, (subroot, ways), top in zip(order, trees, tops, strict=True):
        for (*_, leaf, row), way in zip(sorted(langs[lang], key=lambda r: r[:3]), ways, strict=True):
            changed = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                changed = plain_leaf(*row[:4], row[4] + 1)
            way = way + top
            for before, after in way:
                changed = h(*before, changed, *after)
            proof = h(*[s for before, after in way for s in before + after])
            out.append((row[0], leaf, subroot, root, proof, changed, changed == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("step", [1, 2, 8])
def test_proofs_of_awkward_rows(spark, step):
    data = cases.rows()
    got = merkle.manifest(spark, cases.clashing(cases.documents(spark, data)), step)
    want = plain_manifest(data)
    assert cases.tuples(got, *COLUMNS) == want
    assert not all(r[-1] for r in want) and got.columns == COLUMNS


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 600])
def test_trees_of_any_size(spark, n):
    rng = random.Random(n)
    data = [(i, f"t{i}", rng.choice(["a", "b"]) if n > 2 else "a", "s", i) for i in range(n)]
    assert cases.tuples(merkle.manifest(spark, cases.documents(spark, data), 3), *COLUMNS) == (plain_manifest(data) if n else [])


def test_as_many_trees_as_rows_and_equal_rows(spark):
    data = [(i, "x", f"l{i:03}", "s", 1) for i in range(70)] + [(1, "y", "z", "s", 2)] * 40 + [(None, "y", None, "s", 2)] * 9
    assert cases.tuples(merkle.manifest(spark, cases.documents(spark, data), 2), *COLUMNS) == plain_manifest(data)


def test_a_changed_row_fails_alone():
    nodes = [bytes([k]) * 32 for k in range(11)]
    above = merkle.upwards(nodes, merkle.height(11))
    for place in range(11):
        i, path = place, b""
        for level in above[:-1]:
            path += b"".join(level[i ^ 1 : (i ^ 1) + 1])
            i >>= 1
        assert merkle.folded(nodes[place], path, place, 11) == (above[-1][0], len(path))
        assert merkle.folded(b"x" * 32, path, place, 11)[0] != above[-1][0]
