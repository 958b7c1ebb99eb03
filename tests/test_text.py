import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postweave.functions import text as tx
from postweave.functions.dates import epoch_to_timestamp, parse_date
from postweave.functions.stem import stem_word, stems
from postweave.operators import dictionary as dictionary_module
from postweave.operators import in_row
from postweave.operators import term_odds as odds_module
from postweave.operators.dictionary import (
    build_dictionary,
    count_vectors,
    prepare_text,
    term_counts,
    vocabulary,
)
from postweave.operators.static_features import StaticFeature, affect_scores, static_features
from postweave.operators.tag_codes import decode_tags
from postweave.operators.term_odds import class_rates, term_odds, term_ratios
from postweave.presets import REPLACEMENTS


def _one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


STEMS = {
    "caresses": "caress", "flies": "fli", "dies": "die", "mules": "mule", "denied": "deni",
    "agreed": "agre", "owned": "own", "humbled": "humbl", "meeting": "meet", "stating": "state",
    "itemization": "item", "sensational": "sensat", "traditional": "tradit",
    "reference": "refer", "colonizer": "colon", "plotted": "plot", "skies": "sky",
    "enjoy": "enjoy", "happy": "happi", "is": "is", "été": "été",
}


def test_stems():
    assert {w: stem_word(w) for w in STEMS} == STEMS


def test_stem_arrays_keep_order_repeats_and_nulls(spark):
    rows = [(1, ["cats", "running", "cats"]), (2, None), (3, []), (4, ["flies"])]
    df = spark.createDataFrame(rows, "id long, w array<string>").coalesce(1)
    got = {r.id: r.s for r in df.select("id", stems(F.col("w")).alias("s")).collect()}
    assert got == {1: ["cat", "run", "cat"], 2: None, 3: [], 4: ["fli"]}


def test_clean(spark):
    text = "mail a.b@c.de\tnow @you see\xa0\n http://x.y/z #tag"
    cleaned = _one(spark, text, lambda c: tx.clean(c, REPLACEMENTS))
    assert cleaned.split() == ["mail", "now", "see", "tag"]


def test_clean_long_run(spark):
    """A run of 50,000 characters without '@' is scanned in linear time."""
    assert len(_one(spark, "x" * 50_000, lambda c: tx.clean(c, REPLACEMENTS))) == 50_000


def test_tokens(spark):
    text = "Élan_vital _no 3d x2y ÀB " + "w" * 61
    assert _one(spark, text, tx.tokens) == ["elan_vital", "d", "x", "y", "ab"]
    assert _one(spark, "the dog don t", lambda c: tx.drop_stop_words(tx.tokens(c))) == ["dog"]


def test_empty_token(spark):
    df = spark.createDataFrame([(1, "the"), (2, None)], "id long, text string")
    rows = prepare_text(df, "id", ["text"], keep=()).collect()
    assert {r.id: r.final_text for r in rows} == {1: [""], 2: [""]}


def test_concat_reads_nan(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    both = df.select(tx.concat_columns([F.col("x"), F.col("y")]).alias("t")).first().t
    alone = df.select(tx.concat_columns([F.col("y")]).alias("t")).first().t
    assert (both, alone) == ("a nan", None)


def test_phrases(spark):
    def flag(*words):
        return _one(spark, "Hi ! :D rock on", lambda c: tx.has_phrase(c, words))

    assert [flag("!"), flag(":D"), flag("hi"), flag("h"), flag("rock on")] == [1, 0, 1, 0, 1]
    many = [f"w{i}" for i in range(20)]
    assert [flag(*many), flag(*many, "!"), flag(*many, "rock on"), flag(*many, ":D")] == [0, 1, 1, 0]


def test_tags(spark):
    assert _one(spark, " B ,a,b,", tx.tag_set) == ["", "a", "b"]
    assert _one(spark, None, tx.tag_set) == [""]
    df = spark.createDataFrame([("ab, c",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*tx.tag_statistics(F.col("t"))).collect()]
    assert got == [(2.0, 1.5), (0.0, 0.0)]


def test_dates(spark):
    from datetime import datetime

    assert _one(spark, "Aug 12 2015", parse_date) == datetime(2015, 8, 12)
    assert _one(spark, "86400", epoch_to_timestamp) == datetime(1970, 1, 2)
    assert _one(spark, "bad", lambda c: parse_date(c, strict=False)) is None
    with pytest.raises(Exception):
        _one(spark, "bad", parse_date)


def test_lexicon(spark):
    rows = [("the", 5.0, 4.0, 3.0), ("and", 4.0, 3.0, 2.0)]
    lexicon = spark.createDataFrame(
        rows, "word string, valence double, dominance double, arousal double"
    )
    posts = spark.createDataFrame([(1, "the THE and"), (2, "x"), (3, None)], "id long, text string")
    got = {r.id: (r.valence, r.dominance, r.arousal)
           for r in affect_scores(posts, "id", "text", lexicon).collect()}
    assert got == {1: (14.0, 11.0, 8.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        static_features(spark.range(1), "id", {"x": StaticFeature({"id": "other"})})


def test_dictionary_bounds(spark):
    rows = [(i, ["all", f"t{i % 2}", "rare"] if i == 0 else ["all", f"t{i % 2}"]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, final_text array<string>")
    kept = {r.term: r.df for r in build_dictionary(df, 2, 0.55).collect()}
    assert kept == {"t0": 5, "t1": 5}
    counts = term_counts(df, "id", build_dictionary(df, 2, 1))
    assert counts.agg(F.sum("n")).first()[0] == 20
    empty = build_dictionary(df, 50, 1)
    assert vocabulary(empty) == [] and term_counts(df, "id", empty).count() == 0
    assert count_vectors(df, [], out="v").first().v.size == 0


def test_term_odds_golden(spark):
    rows = [(1, ["x", "x"], True), (2, ["x", "y"], False), (3, ["y"], False), (4, ["z"], True)]
    train = spark.createDataFrame(rows, "id long, final_text array<string>, label boolean")
    terms = build_dictionary(train, 1, 1)
    ratios = term_ratios(class_rates(train, terms), train)
    more = train.unionByName(
        spark.createDataFrame([(5, ["q"], True)], train.schema)
    )
    odds = {r.id: round(r.terms, 9) for r in term_odds(more, "id", ratios).collect()}
    assert odds == {1: 4.0, 2: 8.0, 3: 4.0, 4: 0.125, 5: 1.0}


def test_tag_codes(spark):
    digits = list("abcdefghij")
    tags = spark.createDataFrame([(12, "dog"), (3, "cat")], "number long, tag string")
    df = spark.createDataFrame(
        [(1, "see zzzlblclzzz"), (2, "zzzlold dlzzz end"), (3, "plain")], "id long, t string"
    )
    got = {r.id: r.t for r in decode_tags(df, "id", "t", digits, tags).collect()}
    assert got == {1: "see  dog", 2: "old cat  end", 3: "plain"}
    bad = spark.createDataFrame([(1, "zzzlxlzzz")], "id long, t string")
    with pytest.raises(Exception):
        decode_tags(bad, "id", "t", digits, tags).collect()
    assert decode_tags(df, "id", "t", digits, None).count() == 3


def test_marks_beyond_the_first_blocks_vanish(spark):
    import unicodedata

    samples = ["ガラス", "a⃗b", "é è ñ", "𑂚", "ﬁ 가", "Å"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    found = [r.x for r in df.select(tx.strip_accents(F.col("t")).alias("x")).collect()]
    plain = lambda s: unicodedata.normalize("NFC", "".join(
        c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
    assert found == [plain(s) for s in samples] and found[0] == "カラス"


def test_sums_in_the_row_equal_a_join(spark, monkeypatch):
    rows = [(1, ["a", "b", "a", None, "zz"]), (2, []), (3, None), (4, ["b"] * 5 + ["c"])]
    df = spark.createDataFrame(rows, "id long, final_text array<string>").repartition(3)
    ratios = spark.createDataFrame([("a", 0.5), ("b", -1.0), ("c", None)], "term string, log_ratio double")
    dictionary = ratios.select("term")

    def found():
        odds = {r.id: round(r.log_terms, 9) for r in term_odds(df, "id", ratios).collect()}
        counts = sorted(map(tuple, term_counts(df, "id", dictionary).collect()))
        return odds, counts

    here = found()
    assert here == ({1: 0.0, 2: 0.0, 3: 0.0, 4: -5.0}, [(1, "a", 2), (1, "b", 1), (4, "b", 5), (4, "c", 1)])
    for module in (odds_module, dictionary_module):
        monkeypatch.setattr(module, "small", lambda table: None)
    assert found() == here


def test_words_are_looked_up_in_portions(spark, monkeypatch):
    """No more words at once than the bound, unless one post alone has more; same counts."""
    lists = pa.array([["a"] * 4, None, ["b"] * 9, [], ["a", "b"], ["c"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], names=["id", "w"])
    monkeypatch.setattr(in_row, "WORDS_AT_ONCE", 5)
    parts = list(in_row.portions(batch, 1))
    assert len(parts) > 1 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert max(len(p.column(1).flatten()) for p in parts if p.num_rows > 1) <= 10


def test_cleaning_skips_only_texts_without_a_match(spark):
    texts = ["plain", None, "", "a@b c", "x http://u y", "#tag @me", "two  blanks\tand http", "@", "me@ #http"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.col("t")
    for pattern, text in REPLACEMENTS:
        whole = F.regexp_replace(whole, F.lit(pattern), F.lit(text))
    found = df.select(tx.clean(F.col("t"), REPLACEMENTS).alias("a"), whole.alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]
