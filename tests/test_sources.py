import pytest
from pyspark.sql import functions as F

from postweave.presets import DYNAMIC_FEATURES, GRID_FULL, GRID_SMALL
from postweave.operators import grid as gr
from postweave.sources import delimited, records, store


def test_records_over_several_lines(spark, tmp_path):
    path = tmp_path / "posts.txt"
    path.write_text('id\ttext\n1\t"two\nlines ""quoted"""\n2\tplain\n')
    assert delimited.spans_lines(spark, str(path))
    rows = delimited.read_delimited(spark, str(path), "id long, text string", "\t", "txt").collect()
    assert [(r.id, r.text) for r in rows] == [(1, 'two\nlines "quoted"'), (2, "plain")]
    flat = tmp_path / "flat.csv"
    flat.write_text('id,text\n1,"a, ""b"""\n')
    assert not delimited.spans_lines(spark, str(flat))


def test_unknown_type(spark):
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, "x", "id long", kind="xls")


def test_bad_value_raises(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,text\nx,a\n")
    with pytest.raises(Exception):
        delimited.read_delimited(spark, str(path), "id long, text string").collect()


def test_lexicon_keeps_the_last_row(spark, tmp_path):
    path = tmp_path / "lex.csv"
    path.write_text("Word,valence,dominance,arousal\na,1,1,1\nb,2,2,2\na,3,4,5\n")
    rows = {r.word: (r.valence, r.dominance, r.arousal)
            for r in delimited.read_lexicon(spark, str(path)).collect()}
    assert rows == {"a": (3, 4, 5), "b": (2, 2, 2)}


def test_two_headers(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("A,B,WC,posemo\ntweet_id,text,WC,posemo\n1,x,12,3.5\n2,y,7,0\n")
    rows = delimited.read_two_header(spark, str(path), "tweet_id").collect()
    assert [tuple(r) for r in rows] == [("1", 12.0, 3.5), ("2", 7.0, 0.0)]
    with pytest.raises(ValueError):
        delimited.read_two_header(spark, str(path), "other")


def test_feature_store(spark, tmp_path):
    root = str(tmp_path / "features")
    for cv in (0, 1, "all"):
        key = store.feature_key("p", "lda", "x", {"a": 1, "b": 0.5, "c": "w"}, cv)
        store.write_feature(spark.range(3).withColumn("v", F.lit(str(cv))), root, "x", key, cv)
    assert key == "p_lda(x)_1.0_0.5_w_cv(all)"
    assert {r.v for r in store.read_feature(spark, root, "x", key, "all").collect()} == {"all"}
    read = store.read_feature(spark, root, "x", key, "all")
    assert read.columns == ["id", "v"]


def test_save_table(spark, tmp_path):
    store.save_table(spark.range(4), "saved_posts", str(tmp_path / "t"))
    store.save_table(spark.range(3), "saved_posts", str(tmp_path / "t"))
    assert spark.table("saved_posts").count() == 3
    spark.sql("DROP TABLE saved_posts")


def test_grid_sizes(spark):
    for grid, learners, fits in ((GRID_SMALL, 25, 5), (GRID_FULL, 150, 15)):
        rows = gr.learner_grid(spark, grid, DYNAMIC_FEATURES)
        assert rows.count() == learners
        dynamic = gr.dynamic_grid(spark, grid, DYNAMIC_FEATURES)
        assert dynamic.count() == fits
        assert gr.first_per_feature(dynamic).count() == len(grid["dynamic"])
        shards = [gr.shard(rows, i, 3) for i in range(3)]
        assert sum(s.count() for s in shards) == learners
    filled = gr.fill_dynamic_grid(dynamic)
    assert filled.filter("hashtags_community_graph_type = 'na'").count() == 10
    linear = gr.fill_learner_grid(rows).filter("kernel = 'linear'").first()
    assert (linear.gamma, linear.coef0) == (1.0, 1.0)


def test_experiment_key():
    key = store.experiment_key("p", "test", "svm", ["a", "b"], {"x": "lda"})
    assert key == "p_test_svm_a_b_lda(x)"


def test_id_name_inside_a_text_cell(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("A,B,WC\ntweet_id,text,WC\n1,tweet_id,12\ntweet_id,x,3\n")
    rows = delimited.read_two_header(spark, str(path), "tweet_id").collect()
    assert [tuple(r) for r in rows] == [("1", 12.0), ("tweet_id", 3.0)]


def test_only_the_file_with_long_records_is_read_whole(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    for k in range(3):
        (folder / f"p {k}.csv").write_text(f"id,text\n{k},plain\n{k + 10},\"a, b\"\n")
    (folder / "odd.csv").write_text('id,text\n7,"two\nlines"\n')
    assert len(delimited.files_spanning_lines(spark, str(folder))) == 1
    rows = delimited.read_delimited(spark, str(folder), "id long, text string")
    assert {(r.id, r.text) for r in rows.collect()} == {
        *[(k, "plain") for k in range(3)], *[(k + 10, "a, b") for k in range(3)], (7, "two\nlines"),
    }


def _whole(spark, path, schema, sep=","):
    """The rows as one task reads them."""
    return (
        spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True)
        .schema(schema).csv(path)
    )


CELLS = [
    "plain", "", "two\nlines", 'a ""quoted"" word', 'ends ""', '""', "\n\n", 'x,y\n"",', "l1\nl2\nl3",
    "z" * 90, "tab\there",
]


def _write_records(path, count, end, seed):
    import random

    rng = random.Random(seed)
    lines = ["id,text,more"]
    for i in range(count):
        cells = [f'"{c}"' if set(c) & set('\n",') else c for c in rng.choices(CELLS, k=2)]
        # A quote within an unquoted field is a plain character.
        cells[1] = rng.choice([cells[1], 'six 6" pipe', 'a"b"'])
        lines.append(",".join([str(i), *cells]))
    path.write_bytes((end.join(lines) + (end if seed % 2 else "")).encode())


@pytest.mark.parametrize("size, count, end, seed", [
    (64, 20, "\n", 1), (257, 60, "\n", 2), (257, 60, "\r\n", 3), (1500, 200, "\n", 4),
])
def test_one_file_of_long_records_is_read_in_many_tasks(spark, tmp_path, size, count, end, seed):
    path, schema = tmp_path / "posts.csv", "id long, text string, more string"
    _write_records(path, count, end, seed)
    want = sorted(map(tuple, _whole(spark, str(path), schema).collect()), key=repr)
    assert len(want) == count
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = delimited.read_delimited(spark, str(path), schema).collect()
        blocks = records.read_lines(spark, [str(path)], ",", '"').select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=repr) == want
    assert blocks > 4


def test_records_longer_than_a_range_and_several_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    long = "\n".join(f'line {k} ""x""' for k in range(200))
    for k in range(3):
        (folder / f"f{k}.csv").write_text(f'id,"te\nxt"\n{k},"{long}"\n\n{k + 10},short\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = delimited.read_delimited(spark, str(folder), "id long, text string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    clear = long.replace('""', '"')
    want = {x for k in range(3) for x in ((k, clear), (k + 10, "short"))}
    assert len(rows) == 6 and {(r.id, r.text) for r in rows} == want


def test_a_quote_that_never_closes_fails_or_takes_the_rest(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('id,text\n1,a\n2,"open\n3,b\n')
    rows = records.read_records(spark, [str(path)]).collect()
    assert sorted(r.record for r in rows) == ["1,a", '2,"open\n3,b']


@pytest.mark.parametrize("line, out, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('a"b,"', True, True),
    ('x"', False, False), ('","', False, True), ('""', False, True), ('6" pipe', False, False),
])
def test_state_at_the_end_of_a_line(spark, line, out, inside):
    value = F.lit(line)
    row = spark.range(1).select(
        records.ends_inside(value, ",", '"', records.CLOSED).alias("o"),
        records.ends_inside(value, ",", '"', records.INSIDE).alias("i"),
    ).first()
    assert (row.o, row.i) == (out, inside)
