"""Views of the given tables that stand for posts, tags and prediction sets.

Every view exists as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 1982
OUTER = 5
INNER = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table with texts."""
    return table(spark, sf, name)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a nullable engagement count."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("engagement"))
    return texts(spark, sf).join(labels, "doc_id", "left")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: doc_id, text, lang, source, n_chars, label."""
    labels = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") > 0).alias("label")
    )
    return texts(spark, sf).join(labels, "doc_id")


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the sorted comma list of their part names; odd parts in capitals."""
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 2 == 1, F.upper("p_name"))
        .otherwise(F.col("p_name"))
        .alias("name"),
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    # Two spellings of each of the few part names bound the set per order.
    lists = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("tags"))
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(lists, "id", "left")


def page_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the comma list of the words they link to."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="/(\p{L}+)'), F.lit(1))
    return texts(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        F.nullif(F.array_join(links, ", "), F.lit("")).alias("tags"),
    )


def both_tagged(spark: SparkSession, sf: str) -> DataFrame:
    orders = tagged(spark, sf).withColumn("dataset", F.lit("orders"))
    pages = page_tags(spark, sf).withColumn("dataset", F.lit("pages"))
    return orders.unionByName(pages)


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of four rule models: (experiment, id, cv, pred, true)."""
    rows = labelled(spark, sf)
    rules = {
        "m_len": F.col("n_chars") > 1500,
        "m_lang": F.col("lang") == "en",
        "m_mod": F.col("doc_id") % 3 != 0,
        "m_mix": F.col("label") | (F.col("doc_id") % 5 == 0),
    }
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("experiment"), r.alias("pred")) for n, r in rules.items()])
    )
    return rows.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 5).cast("int").alias("cv"),
        F.col("label").alias("true"),
        each.alias("m"),
    ).select("m.experiment", "id", "cv", "m.pred", "true")


POSTS_SQL = """posts AS (
  SELECT d.*, l.quality AS engagement FROM documents d LEFT JOIN labels l USING (doc_id))"""

LABELLED_SQL = """labelled AS (
  SELECT d.*, l.quality > 0 AS label FROM documents d JOIN labels l USING (doc_id))"""

TAGGED_SQL = """tagged AS (
  SELECT o.o_orderkey AS id, t.tags FROM orders o LEFT JOIN (
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(
      CASE WHEN p_partkey % 2 = 1 THEN upper(p_name) ELSE p_name END))), ', ') AS tags
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) t
  ON o.o_orderkey = t.l_orderkey)"""

PAGE_TAGS_SQL = r"""page_tags AS (
  SELECT page_id AS id, nullif(array_to_string(
    regexp_extract_all(html, '<a href="/(\p{L}+)', 1), ', '), '') AS tags FROM pages)"""

BOTH_TAGGED_SQL = f"""{TAGGED_SQL}, {PAGE_TAGS_SQL}, both_tagged AS (
  SELECT 'orders' AS dataset, id, tags FROM tagged
  UNION ALL SELECT 'pages', id, tags FROM page_tags)"""

PREDS_SQL = f"""{LABELLED_SQL}, preds AS (
  SELECT experiment, doc_id AS id, CAST(doc_id % 5 AS INT) AS cv, pred, label AS "true" FROM (
    SELECT *, 'm_len' AS experiment, n_chars > 1500 AS pred FROM labelled
    UNION ALL SELECT *, 'm_lang', lang = 'en' FROM labelled
    UNION ALL SELECT *, 'm_mod', doc_id % 3 <> 0 FROM labelled
    UNION ALL SELECT *, 'm_mix', label OR doc_id % 5 = 0 FROM labelled))"""


def tag_rows_sql(source: str, extra: str = "") -> str:
    """Distinct lower-cased tags per row of ``source``."""
    cols = f"{extra}, id" if extra else "id"
    return (
        f"SELECT DISTINCT {cols}, lower(trim(t)) AS tag FROM (SELECT {cols}, "
        f"unnest(string_split(coalesce(tags, ''), ',')) AS t FROM {source})"
    )


def sample_sql(labels: str) -> str:
    """Balanced sample of a (doc_id, label) relation, and its nested folds."""
    return f"""ranked AS (
      SELECT doc_id, label,
        row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':{SEED}'), doc_id) AS rn
      FROM {labels}),
    sample AS (SELECT * FROM ranked WHERE rn <=
      (SELECT min(n) FROM (SELECT count(*) AS n FROM {labels} GROUP BY label))),
    placed AS (SELECT *, ntile({OUTER}) OVER (PARTITION BY label ORDER BY rn) - 1 AS own
      FROM sample),
    folds AS (
      SELECT doc_id, label, o AS outer_fold, NULL AS inner_fold
      FROM placed, range({OUTER}) r(o) WHERE own = o
      UNION ALL
      SELECT doc_id, label, o,
        ntile({INNER}) OVER (PARTITION BY o, label ORDER BY rn) - 1
      FROM placed, range({OUTER}) r(o) WHERE own <> o)"""
