import random
import re

import cases
import xxhash

from postweave.llm import line_dedup

UNITS = re.compile(r"(?<=[.!?])(?=\s)|\n")


def plain_units(text):
    """(start, end, words, form) by cutting the text at every unit's end."""
    out, at = [], 0
    cuts = [m.start() for m in UNITS.finditer(text)] + [len(text)]
    for cut in cuts:
        part = text[at:cut]
        if part.split():
            out.append((at + len(part) - len(part.lstrip()), cut, len(part.split()), " ".join(part.lower().split())))
        at = cut
    return out


def plain_repeats(data, least):
    seen, out = {}, []
    def rank(document):
        d, text = document
        key = xxhash.xxh64_intdigest((text or "").encode(), 42)
        return d is None, d or 0, key - 2**64 if key >= 2**63 else key

    for d, text in sorted({(d, t) for d, t, *_ in data}, key=rank):
        run = []
        for a, b, n, form in plain_units(text or ""):
            if form in seen:
                run.append((a, b, n, seen[form]))
                continue
            seen[form] = (d, a)
            out.append((d, run))
            run = []
        out.append((d, run))
    return sorted(
        ((d, r[0][0], r[-1][1], len(r), sum(x[2] for x in r), *r[0][3]) for d, r in out if r and sum(x[2] for x in r) >= least), key=repr
    )


def test_units():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab .!?\n\t") for _ in range(rng.randint(0, 40)))
        assert [u for u in line_dedup.units_of(text)] == plain_units(text)


def test_runs_equal_a_plain_pass(spark):
    data = cases.rows()
    got = line_dedup.repeats(spark, cases.clashing(cases.documents(spark, data)))
    columns = ("doc_id", "start", "end", "n_units", "n_words", "kept_doc_id", "kept_start")
    assert cases.tuples(got, *columns) == plain_repeats(data, 20)
    assert line_dedup.repeats(spark, cases.documents(spark, [])).count() == 0


def test_null_ids_rank_last(spark):
    passage = cases.sentence(random.Random(9), 60)
    data = [(None, passage, "en", "s", 1), (7, f"Own words. {passage}", "en", "s", 1), (8, "Clean words here.", None, None, None)]
    got = line_dedup.repeats(spark, cases.documents(spark, data)).collect()
    assert [(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in got] == [(None, 0, len(passage), 7, 11)]


def test_rows_of_one_id_and_of_none(spark):
    rng = random.Random(4)
    passage, other, more = (cases.sentence(rng, n) for n in (60, 90, 40))
    texts = [(1, passage), (7, passage), (7, other), (None, passage), (None, f"{more}. {passage}"), (None, more)]
    docs = cases.documents(spark, [(d, t, "en", "s", 1) for d, t in texts])
    got = line_dedup.repeats(spark, docs)
    assert cases.tuples(got, "doc_id", "start", "end", "n_units", "n_words", "kept_doc_id", "kept_start") == plain_repeats(
        [(d, t) for d, t in texts], 20)
    left = {(r.doc_id, r.text) for r in line_dedup.without_repeats(spark, docs).collect()}
    assert {(1, passage), (7, ""), (7, other), (None, "")} <= left
    # No text loses what is not repeated; a unit with a full stop is another one.
    assert sum(t is not None and more in t for _, t in left) == 2


def test_cut_can_be_undone(spark):
    data = [r for r in cases.rows() if r[0] is not None]
    docs = cases.documents(spark, data).withColumnRenamed("lang", "spans_of")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = line_dedup.without_repeats(spark, docs).collect()
    assert len(rows) == len(data)
    for r in rows:
        text, left, at = before[r.doc_id], "", 0
        for s in r.removed_spans:
            left, at = left + text[at : s.start], s.end
        assert r.text == (text if text is None else left + text[at:])
