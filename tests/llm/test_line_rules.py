import os
import sys

import cases
import pytest
from oracle import compare, connect

from postweave.llm import line_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def plain_base(text):
    words = cases.WORD.findall(text or "")
    wins = {}
    for i in range(len(words) - 7):
        wins.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if cases.WORD.search(x)]
    n, r = len(words), len(inside)
    return (
        n, sum(map(len, words)), sum((text or "").count(c) for c in line_rules.SYMBOLS),
        len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n,
    )


def test_base_figures(spark):
    rows, _ = line_rules.verdicts(spark, cases.clashing(cases.documents(spark)))
    got = cases.tuples(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((d, *plain_base(t)) for d, t, *_ in cases.rows()), key=repr)


def test_frequent_lines_go_but_for_the_first(spark):
    line = "one two three four five six seven eight nine ten eleven 2024"
    letter = lambda n: chr(97 + n % 26) + chr(97 + n // 26)
    own = lambda i: " ".join(letter(i) + letter(k) for k in range(30))
    data = [(i, f"{own(i)}\n{line.upper() if i % 2 else line}", "en", "h", 0) for i in range(10)]
    data += [(20 + i, f"{' '.join(own(i).split()[:3])}\n{line}", "en", "h", 0) for i in range(4)]
    data += [(30 + i, f"{own(30)}\n{line}", "en", "h", 0) for i in range(3)]  # copies: one text
    data += [(40, f"{own(40)}\n{line}", "en", "other", 0), (41, None, "en", None, None)]
    docs = cases.clashing(cases.documents(spark, data))
    rows, removed = line_rules.verdicts(spark, docs, max_texts=5)
    kept = {r.doc_id: (r.kept, r.n_words - r.words_left) for r in rows.collect()}
    assert kept[0] == (True, 0) and kept[40] == (True, 0)
    assert all(kept[i] == (True, 12) for i in (*range(1, 10), 30, 31, 32))
    assert all(kept[20 + i] == (False, 12) for i in range(4)) and kept[41] == (False, 0)
    cleaned = line_rules.clean(spark, docs, max_texts=5)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()}
    assert texts[0] == (f"{own(0)}\n{line}", 0) and texts[3] == (own(3), len(own(3)))
    assert sorted(texts) == [*range(10), 30, 31, 32, 40]


def test_no_documents(spark):
    rows, _ = line_rules.verdicts(spark, cases.documents(spark, []))
    assert rows.count() == 0 and line_rules.clean(spark, cases.documents(spark, [])).count() == 0


def test_the_rest_stands_without_this_package():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('postweave.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
    )
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
