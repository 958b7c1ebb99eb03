"""Static post features, text preparation, dictionaries and term odds."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave import presets
from postweave.functions import text as tx
from postweave.operators import dictionary as di
from postweave.operators import folds as fo
from postweave.operators import static_features as sf_
from postweave.operators import term_odds as to
from postweave.operators.static_features import StaticFeature
from postweave.operators.tag_codes import decode_tags
from postweave.plans.prep import _POST_LABELS, post_folds
from postweave.plans.registry import query
from postweave.plans.views import (
    LABELLED_SQL,
    POSTS_SQL,
    TAGGED_SQL,
    labelled,
    posts,
    sample_sql,
    table,
    texts,
    tagged,
)
from postweave.session import scratch_path, stage
from postweave.sources import delimited

NO_BELOW, NO_ABOVE = 10, 0.5

# -- static features ------------------------------------------------------------

META = {
    "n_chars": StaticFeature({"n_chars": "numerical"}),
    "engaged": StaticFeature({"engagement": "boolean"}),
    "character": StaticFeature({"text": "length"}),
    "origin": StaticFeature({"lang": "length", "source": "length"}),
    **{
        name: StaticFeature({"text": "lookup"}, tuple(words))
        for name, words in presets.PHRASES.items()
    },
}


def _phrase_sql(words, text="text") -> str:
    tests = [
        "contains(' ' || lower({}) || ' ', ' {} ')".format(text, w.replace("'", "''"))
        for w in words
    ]
    return f"CAST({' OR '.join(tests)} AS DOUBLE)"


@query(
    "static_meta_features",
    f"""WITH {POSTS_SQL} SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars,
        CAST(engagement IS NOT NULL AS DOUBLE) AS engaged, CAST(length(text) AS DOUBLE) AS character,
        CAST(length(lang) AS DOUBLE) AS origin_lang, CAST(length(source) AS DOUBLE) AS origin_source,
        {', '.join(f'{_phrase_sql(w)} AS {n}' for n, w in presets.PHRASES.items())} FROM posts""",
)
def static_meta_features(spark, sf):
    return sf_.static_features(posts(spark, sf), "doc_id", META)


@query(
    "static_account_features",
    f"""WITH {TAGGED_SQL} SELECT o_orderkey, o_totalprice AS price, c_acctbal AS balance,
        CAST(date_diff('day', DATE '2005-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS age,
        CAST(c_mktsegment IS NOT NULL AS DOUBLE) AS segment,
        CAST(CASE WHEN tags IS NULL THEN 0 ELSE len(string_split(tags, ',')) END AS DOUBLE)
          AS hashtags_count,
        round(CASE WHEN tags IS NULL THEN 0.0 ELSE list_sum(list_transform(string_split(tags, ','),
          lambda t: length(trim(t)))) / len(string_split(tags, ',')) END, 9) AS hashtags_sum
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN tagged ON id = o_orderkey""",
)
def static_account_features(spark, sf):
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    rows = orders.join(tagged(spark, sf).withColumnRenamed("id", "o_orderkey"), "o_orderkey")
    features = {
        "price": StaticFeature({"o_totalprice": "numerical"}),
        "balance": StaticFeature({"c_acctbal": "numerical"}),
        "age": StaticFeature({"o_orderdate": "age_of_account"}),
        "segment": StaticFeature({"c_mktsegment": "boolean"}),
        "hashtag": StaticFeature({"tags": "hashtag"}),
    }
    found = sf_.static_features(rows, "o_orderkey", features)
    return found.withColumn("hashtags_sum", F.round("hashtags_sum", 9))


# Phrases that occur in the documents, long enough to use the one-pass lookup.
_FREQUENT = "the and of to in der die und sch el los de la et les que".split() + ["of the"]


@query(
    "phrase_flags",
    f"""SELECT doc_id, CAST({_phrase_sql(_FREQUENT)} AS INT) AS frequent,
        CAST({_phrase_sql(['the', 'The', '.'])} AS INT) AS few FROM documents""",
)
def phrase_flags(spark, sf):
    text = F.col("text")
    return texts(spark, sf).select(
        "doc_id",
        tx.has_phrase(text, _FREQUENT).alias("frequent"),
        tx.has_phrase(text, ["the", "The", "."]).alias("few"),
    )


@query(
    "lexicon_scores",
    """WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word
         FROM documents),
       counts AS (SELECT word, count(*) AS n FROM words GROUP BY word),
       lex AS (SELECT word, CAST(length(word) % 9 AS DOUBLE) AS valence,
           CAST(ascii(word) % 7 AS DOUBLE) AS dominance, CAST(n % 5 AS DOUBLE) AS arousal
         FROM counts WHERE n >= 10),
       sums AS (SELECT doc_id, sum(valence) AS valence, sum(dominance) AS dominance,
           sum(arousal) AS arousal FROM words JOIN lex USING (word) GROUP BY doc_id)
       SELECT doc_id, coalesce(valence, 0) AS valence, coalesce(dominance, 0) AS dominance,
         coalesce(arousal, 0) AS arousal FROM documents LEFT JOIN sums USING (doc_id)""",
)
def lexicon_scores(spark, sf):
    docs = texts(spark, sf)
    words = docs.select(F.explode(tx.latin_words(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    lexicon = counts.select(
        F.col("word").alias("Word"),
        (F.length("word") % 9).cast("double").alias("valence"),
        (F.ascii("word") % 7).cast("double").alias("dominance"),
        (F.col("n") % 5).cast("double").alias("arousal"),
    )
    path = scratch_path(spark, "lexicon")
    delimited.write_delimited(lexicon, path)
    stored = stage(delimited.read_lexicon(spark, path), "lexicon")
    return sf_.affect_scores(docs, "doc_id", "text", stored)


@query(
    "two_header_import",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS WC,
         CAST(n_chars AS DOUBLE) AS chars FROM documents""",
)
def two_header_import(spark, sf):
    docs = table(spark, sf, "documents")
    body = docs.select(
        F.col("doc_id").cast("string").alias("A"),
        F.col("lang").alias("B"),
        F.size(F.split("text", " ")).cast("string").alias("WC"),
        F.col("n_chars").cast("string").alias("chars"),
    )
    names = spark.createDataFrame([("doc_id", "lang", "WC", "chars")], body.schema)
    path = scratch_path(spark, "categories")
    delimited.write_delimited(names.unionByName(body), path)
    return delimited.read_two_header(spark, path, "doc_id")


# -- text -----------------------------------------------------------------------

# The replacements in the dialect of the SQL engine.
_SQL_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_SQL_SOLID = r"[^\s\p{Z}\x0b\x1c-\x1f\x85]"


def _clean_sql(text: str) -> str:
    steps = [
        rf"{_SQL_SOLID}*@{_SQL_SOLID}*{_SQL_BLANK}?",
        rf"@{_SQL_SOLID}+",
        rf"{_SQL_BLANK}+",
        rf"http{_SQL_SOLID}+",
        "#",
    ]
    for step in steps:
        text = f"regexp_replace({text}, '{step}', ' ', 'g')"
    return text


_STOP_LIST = ", ".join("'{}'".format(w.replace("'", "''")) for w in presets.STOP_WORDS)


def _tokens_sql(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(strip_accents(lower({text})), '{tx.WORD_RUN}'), "
        f"lambda t: length(t) BETWEEN 1 AND 60 AND NOT starts_with(t, '_') "
        f"AND NOT list_contains([{_STOP_LIST}], t))"
    )


def _prepared_sql(source: str, cols: str = "doc_id, label") -> str:
    words = _tokens_sql(_clean_sql("text"))
    return f"""words AS MATERIALIZED (SELECT {cols}, CASE WHEN len(w) = 0 THEN [''] ELSE w END AS w
      FROM (SELECT {cols}, {words} AS w FROM {source}))"""


@query(
    "text_clean",
    f"""WITH {POSTS_SQL}, c AS (
          SELECT doc_id, text || ' ' || coalesce(CAST(engagement AS VARCHAR), 'nan') AS orig_text
          FROM posts)
        SELECT doc_id, orig_text, {_clean_sql('orig_text')} AS cleaned_text FROM c""",
)
def text_clean(spark, sf):
    joined = tx.concat_columns([F.col("text"), F.col("engagement")])
    rows = posts(spark, sf).select("doc_id", joined.alias("orig_text"))
    return rows.withColumn("cleaned_text", tx.clean(F.col("orig_text"), presets.REPLACEMENTS))


@query(
    "tokens_no_stop",
    f"""WITH {_prepared_sql('documents', 'doc_id')}
        SELECT doc_id, len(w) AS n, array_to_string(w, ', ') AS final_text FROM words""",
)
def tokens_no_stop(spark, sf):
    rows = di.prepare_text(texts(spark, sf), "doc_id", ["text"], stemming=False)
    return rows.select(
        "doc_id", F.size("final_text").alias("n"), F.array_join("final_text", ", ").alias("final_text")
    )


@query(
    "token_list_parse",
    f"""WITH {TAGGED_SQL} SELECT id, list_transform(string_split(coalesce(tags, ''), ','),
          lambda t: trim(t)) AS terms FROM tagged""",
)
def token_list_parse(spark, sf):
    return tagged(spark, sf).select("id", tx.parse_list(F.col("tags")).alias("terms"))


@query("stemmed_vocab")
def stemmed_vocab(spark, sf):
    rows = di.prepare_text(texts(spark, sf), "doc_id", ["text"])
    return di.document_frequency(rows)


# -- dictionary, counts, odds -----------------------------------------------------

_TRAIN_SQL = f"""{LABELLED_SQL}, {_prepared_sql('labelled')},
  df AS (SELECT term, count(*) AS df FROM (
      SELECT DISTINCT doc_id, unnest(w) AS term FROM words) GROUP BY term),
  dict AS MATERIALIZED (SELECT * FROM df
    WHERE df BETWEEN {NO_BELOW} AND (SELECT floor(count(*) * {NO_ABOVE}) FROM words)
    ORDER BY df DESC, term LIMIT {presets.KEEP_TERMS}),
  tok AS MATERIALIZED (SELECT doc_id, label, term FROM (
    SELECT doc_id, label, unnest(w) AS term FROM words) SEMI JOIN dict USING (term))"""


def _train(spark, sf):
    """Labelled documents with their tokens, stored once for the passes over them."""
    rows = di.prepare_text(
        labelled(spark, sf), "doc_id", ["text"], stemming=False, keep=("label",)
    )
    return stage(rows.select("doc_id", "label", "final_text"), "tokens")


def _dictionary(train):
    return stage(di.build_dictionary(train, NO_BELOW, NO_ABOVE), "dictionary")


@query("dictionary_filter", f"WITH {_TRAIN_SQL} SELECT term, df FROM dict")
def dictionary_filter(spark, sf):
    return di.build_dictionary(_train(spark, sf), NO_BELOW, NO_ABOVE)


@query(
    "term_counts",
    f"WITH {_TRAIN_SQL} SELECT doc_id, term, count(*) AS n FROM tok GROUP BY doc_id, term",
)
def term_counts(spark, sf):
    train = _train(spark, sf)
    return di.term_counts(train, "doc_id", _dictionary(train))


_FOLD_SQL = f"""{_POST_LABELS}, {sample_sql('post_labels')},
  split AS (SELECT f.doc_id, f.label, d.text, f.inner_fold = 1 AS held FROM folds f
    JOIN documents d USING (doc_id) WHERE f.outer_fold = 0 AND f.inner_fold IS NOT NULL),
  {_prepared_sql('split', 'doc_id, label, held')},
  train AS (SELECT * FROM words WHERE NOT held),
  df AS (SELECT term, count(*) AS df FROM (
      SELECT DISTINCT doc_id, unnest(w) AS term FROM train) GROUP BY term),
  dict AS MATERIALIZED (SELECT * FROM df
    WHERE df BETWEEN {NO_BELOW} AND (SELECT floor(count(*) * {NO_ABOVE}) FROM train)
    ORDER BY df DESC, term LIMIT {presets.KEEP_TERMS})"""


@query(
    "bow_counts",
    f"""WITH {_FOLD_SQL}, tok AS (SELECT doc_id, held, unnest(w) AS term FROM words)
        SELECT doc_id, held, term, count(*) AS n FROM tok SEMI JOIN dict USING (term)
        GROUP BY doc_id, held, term""",
)
def bow_counts(spark, sf):
    """Counts of a training and a validation fold over the training dictionary."""
    folds = post_folds(spark, sf, only=0).filter(F.col("inner_fold").isNotNull())
    ids = folds.select("doc_id", (F.col("inner_fold") == 1).alias("held"))
    # Only sampled posts are tokenised.
    docs = table(spark, sf, "documents").select("doc_id", "text").join(ids, "doc_id", "right")
    rows = di.prepare_text(docs, "doc_id", ["text"], stemming=False, keep=("held",))
    rows = stage(rows.select("doc_id", "held", "final_text"), "tokens")
    terms = _dictionary(rows.filter(~F.col("held")))
    return di.term_counts(rows, "doc_id", terms, keep=("held",))


_RATES_SQL = f"""{_TRAIN_SQL},
  sizes AS (SELECT count(*) FILTER (label) AS np, count(*) FILTER (NOT label) AS nn,
      count(*) AS n FROM words),
  rates AS (SELECT term, count(*) FILTER (label) / any_value(np) AS pos,
      count(*) FILTER (NOT label) / any_value(nn) AS neg FROM tok, sizes GROUP BY term)"""


@query(
    "term_class_rates",
    f"WITH {_RATES_SQL} SELECT term, round(pos, 9) AS pos, round(neg, 9) AS neg FROM rates",
)
def term_class_rates(spark, sf):
    train = _train(spark, sf)
    rates = to.class_rates(train, _dictionary(train))
    return rates.withColumns({c: F.round(c, 9) for c in ("pos", "neg")})


@query(
    "term_odds",
    f"""WITH {_RATES_SQL}, r AS (SELECT term,
          ln(CASE WHEN pos > 0 THEN pos ELSE n END) - ln(CASE WHEN neg > 0 THEN neg ELSE n END) AS x
          FROM rates, sizes),
        s AS (SELECT doc_id, sum(x) AS x FROM tok JOIN r USING (term) GROUP BY doc_id)
        SELECT doc_id, round(coalesce(x, 0), 6) AS log_terms FROM words LEFT JOIN s USING (doc_id)""",
)
def term_odds(spark, sf):
    train = _train(spark, sf)
    ratios = stage(to.term_ratios(to.class_rates(train, _dictionary(train)), train), "ratios")
    odds = to.term_odds(train, "doc_id", ratios)
    return odds.select("doc_id", F.round("log_terms", 6).alias("log_terms"))


# -- coded tags -------------------------------------------------------------------



@query(
    "tag_decode",
    """SELECT p_partkey, 'see  ' || p_name || '  and  ' || 'old ' || p_name AS text FROM part""",
)
def tag_decode(spark, sf):
    """Part keys written digit by digit as coded tags, decoded to part names."""
    part = table(spark, sf, "part")
    digits = F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda d: d != "")
    words = F.transform(
        digits, lambda d: F.element_at(F.array(*[F.lit(w) for w in _CODES]), d.cast("int") + 1)
    )
    code = F.array_join(words, "l")
    coded = part.select(
        "p_partkey",
        F.concat(
            F.lit("see zzzl"), code, F.lit("lzzz and zzzlold "), code, F.lit("lzzz")
        ).alias("text"),
    )
    names = part.select(F.col("p_partkey").alias("number"), F.col("p_name").alias("tag"))
    return decode_tags(coded, "p_partkey", "text", _CODES, names)


# Digit words free of the separator letter.
_CODES = ["ozo", "one", "two", "tri", "for", "fif", "six", "sev", "oct", "nin"]
