from itertools import permutations

import cases
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postweave.llm import filter_audit
from postweave.llm.common import Staging


def fails(text, doc_id, data):
    words = cases.WORD.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in data),
    }


def plain_audit(data, labels):
    docs = [(d, s or "", fails(t or "", d, data)) for d, t, _, s, _ in data]
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    out = []
    for part in {s for _, s, _ in docs}:
        own = [(d, f) for d, s, f in docs if s == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[k]]
                left = [(d, f) for d, f in left if not f[k]]
                shapley[k] += len(gone)
                failing = [f for _, f in own if f[k]]
                rows.append((
                    part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                    sum(sum(f.values()) == 1 for f in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out, key=repr)


def more_rows():
    data = cases.rows()
    long = " ".join(f"w{k % 150}" for k in range(260))
    data += [(300 + k, long + " X" * k, "en", "s9", 1) for k in range(0, 40, 8)]
    data += [(400 + k, "SAME Shout! " * 100, "en", None if k % 2 else "", 1) for k in range(6)]
    data += [(500, " ".join(f"v{k}" for k in range(300)), "en", "s9", 1), (501, "$ " + " ".join(f"v{k}" for k in range(300)), "en", "s9", 1)]
    return data


def test_all_orders_of_awkward_rows(spark):
    data = more_rows()
    ids = [d for d, *_ in data]
    labels = [(d, k % 2, int(k % 5 == 0)) for k, d in enumerate(ids)] + [(3, 1, 0), (3, 0, None), (9999, 1, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, cases.clashing(cases.documents(spark, data)), marked)
    want = plain_audit(data, labels)
    assert cases.tuples(got, *got.columns) == want
    # Something is counted in every column.
    assert all(any(r[c] for r in want) for c in range(3, 10))


def test_no_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, cases.documents(spark, []), labels).count() == 0
    data = more_rows()
    got = filter_audit.audit(spark, cases.documents(spark, data), labels)
    assert cases.tuples(got, *got.columns) == plain_audit(data, [])


def test_shards_are_the_matrix_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PORTION", 2000)
    data = more_rows()
    docs = cases.documents(spark, data).repartition(3)
    shards, known = filter_audit.matrix_shards(Staging(spark), docs)
    words = {r.id: r.word for r in known.collect()}
    every = {w for _, t, *_ in data for w in cases.WORD.findall(t or "")}
    assert sorted(words) == list(range(len(every))) and set(words.values()) == every
    found = []
    rows = shards.collect()
    assert len(rows) > 3
    for row in rows:
        entries, columns, values = filter_audit.unpack(row.matrix)
        assert len(entries) == len(row.docs)
        ends = np.cumsum(entries)
        for doc, end, n in zip(row.docs, ends, entries, strict=True):
            cells = {words[c]: int(v) for c, v in zip(columns[end - n : end], values[end - n : end], strict=True)}
            found.append((doc.doc_id, sorted(cells.items())))
    want = []
    for d, t, *_ in data:
        counts = {}
        for w in cases.WORD.findall(t or ""):
            counts[w] = counts.get(w, 0) + 1
        want.append((d, sorted(counts.items())))
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_marks_of_sliced_texts():
    texts = pa.array(["xx", "Aé#", "", "中|B", "c" * 50])
    for part, want in ((texts, [(0, 2, 0), (1, 3, 1), (0, 0, 0), (1, 3, 1), (0, 50, 0)]), (texts.slice(1, 3), [(1, 3, 1), (0, 0, 0), (1, 3, 1)])):
        assert list(zip(*map(np.ndarray.tolist, filter_audit.marks_of(part)), strict=True)) == want
