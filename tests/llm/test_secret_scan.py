import hashlib
import math
import os
import random
import re
import string

import cases
import pytest

from postweave.llm import secret_scan as scan

PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_of(text):
    found = []
    for order, (kind, (pattern, passes)) in enumerate(PATTERNS.items()):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if passes(m)]
    return [s for _, _, s in sorted(found)]


def windows_of(value, width, bits):
    """Entropy of each window counted anew."""
    covered = set()
    for i in range(len(value) - width + 1):
        part = value[i : i + width]
        p = [part.count(c) / width for c in set(part)]
        if -sum(x * math.log2(x) for x in p) >= bits - 1e-9:
            covered |= set(range(i, i + width))
    return covered


def test_base_of_every_row(spark):
    docs = cases.documents(spark)
    got = scan.scanned(cases.clashing(docs)).collect()
    want = sorted(
        (repr(d), hashlib.sha256(",".join(base_of(t)).encode()).hexdigest()) for d, t, *_ in cases.rows()
    )
    assert sorted((repr(r.doc_id), r.base_sha256) for r in got) == want
    one = next(r for r in got if r.doc_id == 205)
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 1, 1)
    assert set(base_of(dict((d, t) for d, t, *_ in cases.rows())[205])) <= set(one.spans.split(","))
    assert scan.scanned(cases.documents(spark, [])).count() == 0


@pytest.mark.parametrize("value", [
    "k8Xz2Lq9Vb4Nw7Rt1Ys5Pd3Fg6Hj0", "aaaaaaaaaaaaaaaaaaaaaaaaaa1B2", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822c",
    "aaaaaaaaaaaaaaaaaaaaaaaaQ7zX9cV2bN4mL6kJ8hG0aaaaaaaaaaaaaaaaaaaaaaaa",
])
def test_windows_equal_recount(value):
    kind = next(c for c in scan.CLASSES if c.member.fullmatch(value))
    want = windows_of(value, kind.width, kind.bits)
    got = {i for a, b in scan.entropy_spans(f"x {value} y") for i in range(a - 2, b - 2)}
    assert got == want


@pytest.mark.parametrize("value", [
    "enbeschverauheitderverachberchheitsch", "some-path/of/plain/words/and/more", "123e4567-e89b-12d3-a456-426614174000",
    "20240101-20240202-20240303", "SomeVeryLongCamelCaseNameOfAThing",
])
def test_allowed_strings(value):
    assert scan.entropy_spans(value) == []


def test_redaction_keeps_the_rest(spark):
    docs = cases.clashing(cases.documents(spark))
    got = {(r.doc_id, r.text, r.n_chars) for r in scan.redact(docs).collect()}
    assert (205, "x <assign> <access> <hex>", 25) in {(d, t.replace('"', ""), n - 1) for d, t, n in got if d == 205}
    assert {x for x in got if x[0] != 205} == {(d, t, n) for d, t, _, _, n in cases.rows() if d != 205}
    assert scan.redact(docs).columns == docs.columns


def test_long_candidates_take_one_pass():
    for value in ("a" * 200_000 + "9" * 9, "Ab" * 100_000 + "-", "-a" * 100_000 + "=9"):
        scan.all_spans(f"token {value} x")


# Single-case keys of letters alone look like words; of base32 so many have no digit.
@pytest.mark.parametrize("alphabet, lost", [
    ("0123456789abcdef", 0.005), (string.ascii_lowercase + string.digits, 0.01), (string.ascii_uppercase + string.digits, 0.01),
    (string.ascii_uppercase + "234567", 0.025), (string.ascii_letters + string.digits, 0.005),
    (string.ascii_letters + string.digits + "+/", 0.005), (string.ascii_letters + string.digits + "-_", 0.005),
])
@pytest.mark.parametrize("length", [20, 22, 32, 40])
def test_random_keys_are_covered_whole(alphabet, lost, length):
    rng = random.Random(length)
    missed = 0
    for _ in range(4000):
        key = "".join(rng.choices(alphabet, k=length))
        text = f"Mine: {key}. Yours"
        missed += key[:4] in scan.redacted(text, scan.all_spans(text)) or key[-4:] in scan.redacted(text, scan.all_spans(text))
    assert missed <= lost * 4000, missed / 4000


def test_pairs_of_a_window_equal_a_recount():
    rng = random.Random(5)
    for _ in range(300):
        value = "".join(rng.choices("thereinonAZq09_-", k=rng.randint(20, 60)))
        kind = scan.CharClass("any", re.compile(".*"), 20, 2.0)
        want = []
        for i in range(len(value) - 19):
            part = value[i : i + 20]
            pairs = [scan._pair(a, b) for a, b in zip(part, part[1:])]
            names = sum(u for u, _ in pairs) >= scan.NAME_SHARE * sum(c for _, c in pairs)
            if windows_of(part, 20, 2.0) and not names:
                want.append((i, i + 20))
        assert list(scan._windows(value, kind)) == want


@pytest.mark.parametrize("value", [
    "_pending_bytes_count", "SimpleHTTPRequestHandler", "_UNIVERSAL_CONFIG_VARS", "/usr/local/lib/python3",
    "org/apache/spark/sql/catalyst/SQLConf", "x86_64-unknown-linux-gnu-gcc12", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "eu/bitstream/10419/207829/1/10", "99832_20655_58879_37690e-1", "IMAP4_server_hostname",
])
def test_names_are_no_secrets(value):
    assert scan.candidate_spans(f"see {value}.") == []


def test_a_key_within_a_long_path_is_found():
    key = "k8Xz2Lq9Vb4Nw7Rt1Ys5Pd3F"
    text = f"/the/path/of/some/very/long/name/that/reads/as/words/{key}"
    assert scan.candidate_spans(text) == [(0, len(text))]


def test_few_strings_of_a_code_base_are_taken():
    """Distinct candidates in the standard library's own modules: names of all styles."""
    folder = os.path.dirname(os.__file__)
    taken, names = set(), set()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".py"):
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                text = f.read()
            names |= {m.group() for m in scan.CANDIDATE.finditer(text)}
            taken |= {text[a:b] for a, b in scan.candidate_spans(text)}
    assert len(names) > 1000 and len(taken) <= 20, sorted(taken)


@pytest.mark.parametrize("value", ["articles/2024/01/05/some-plain-title", "IMG_2024-01-05_Holiday-Photo"])
def test_allowed_paths(value):
    assert scan.candidate_spans(value) == []
