import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postweave.llm import packing, token_counts
from postweave.llm.bpe import tokenizer, vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    alphabet = "aàáÀİΣσςß ẞﬁ…½Ⅳ٣中文😀👩‍'’sS tT<|>́  \x1c\x85\n\t​#@!ëÅK"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [None, "", "it's we'LL they'Re", "a<|endoftext|>b <|startoftext|>", "aaaa" * 50, "<|ENDOFTEXT|>"]
    bpe = tokenizer(PATH)
    for _ in range(2):  # the second time from the kept chunks
        flat, n = bpe.encode(pa.array(texts))
        parts = np.split(flat, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [ids_of(library, t) for t in texts]
        assert bpe.count(pa.array(texts)).tolist() == n.tolist()
    assert bpe.count(pa.array([], pa.string())).tolist() == []


def test_counts(spark, library):
    got = cases.tuples(token_counts.counted(cases.clashing(cases.documents(spark))), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), n := len(ids_of(library, t)), n > 2048) for d, t, *_ in cases.rows()]
    assert got == sorted(want, key=repr)
    assert token_counts.counted(cases.documents(spark, [])).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return len(bins)


@pytest.mark.parametrize("cell", [20_000, 16])
def test_packing_is_whole_and_close_to_the_bound(spark, library, cell):
    rows = packing.packed(spark, cases.clashing(cases.documents(spark)), cell=cell).collect()
    want = []
    for d, t, *_ in cases.rows():
        ids = [*ids_of(library, t), 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((d, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    n = check_packing(rows, 4096)
    assert n <= packing.lower_bound(np.array([r.length for r in rows])) + 1


def test_empty_packing(spark):
    assert packing.packed(spark, cases.documents(spark, [])).count() == 0


def test_bounds_against_exact_packing():
    def exact(lengths, capacity):
        best = len(lengths)

        def place(k, left):
            nonlocal best
            if len(left) >= best:
                return
            if k == len(lengths):
                best = len(left)
                return
            for i in range(len(left)):
                if left[i] >= lengths[k]:
                    place(k + 1, [*left[:i], left[i] - lengths[k], *left[i + 1 :]])
            place(k + 1, [*left, capacity - lengths[k]])

        place(0, [])
        return best

    rng = random.Random(5)
    met = 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(7)), reverse=True)
        true = exact(lengths, 20)
        bound = packing.lower_bound(np.array(lengths), 20)
        bins, _, left = packing.best_fit(np.array(lengths), 20)
        assert bound <= true <= len(left) == bins.max() + 1
        met += bound == true
    assert met > 40
