"""Registered queries of the operators, and the SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm import (
    filter_audit,
    interpolation,
    line_dedup,
    line_rules,
    merkle,
    mixing,
    near_vectors,
    packing,
    secret_scan,
    sharding,
    simhash,
    subword_quality,
    token_counts,
)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors.near_duplicates(spark, spark.read.parquet(f"{sf}/embeddings.parquet"))


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scanned(documents(spark, sf))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(spark, documents(spark, sf))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.repeats(spark, documents(spark, sf))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = line_rules.verdicts(spark, documents(spark, sf))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "words_left",
    )


def op6_deleted_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    return interpolation.scored(spark, documents(spark, sf))


def op7_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.replicate(spark, documents(spark, sf))


def op8_virtual_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(spark, documents(spark, sf)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(spark, documents(spark, sf))


def op11_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return subword_quality.scored(spark, documents(spark, sf), labels)


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return filter_audit.audit(spark, documents(spark, sf), labels)


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(spark, documents(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_dedup,
        op2_secret_scan,
        op3_best_fit_packing,
        op4_line_dedup,
        op5_quality_rules,
        op6_deleted_interpolation,
        op7_source_mix,
        op8_virtual_shards,
        op9_token_counts,
        op10_simhash,
        op11_subword_quality,
        op12_filter_audit,
        op13_merkle_manifest,
    )
}

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
again AS (
  SELECT r, i FROM windows JOIN (
    SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1) USING (r, win)),
repeated AS (
  SELECT r, count(DISTINCT place) AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS place FROM again) GROUP BY r),
lines AS (
  SELECT r, doc_id, source, text, l FROM (
    SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
held AS (
  SELECT r, doc_id, source, text, trim(regexp_replace(regexp_replace(
    lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS k,
    len(regexp_extract_all(l, '{WORD}')) AS n
  FROM lines),
frequent AS (
  SELECT source, k, arg_min(text, doc_id) AS holder FROM held
  GROUP BY source, k HAVING count(DISTINCT text) > {line_rules.MAX_TEXTS}),
lost AS (
  SELECT r, sum(n) AS n FROM held JOIN frequent
  ON held.source IS NOT DISTINCT FROM frequent.source AND held.k = frequent.k
  WHERE text <> holder GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ws) - coalesce(lost.n, 0) AS BIGINT) AS words_left
  FROM d LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND words_left >= {line_rules.MIN_WORDS}
    AND 100 * words_left >= {line_rules.MIN_LEFT} * n_words AS kept, words_left
FROM (SELECT *, n_words < {line_rules.MIN_WORDS}
  OR 100 * n_repeat_words > {line_rules.MAX_REPEATED} * n_words AS base_failed FROM base)
"""

# Rates of the given tables are far below mixing.PART, so each draw is one part.
MIX_SQL = f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(bytes) * (SELECT sum(bytes) / sum(sqrt(bytes)) FROM sizes) / bytes AS rate
  FROM sizes),
terms AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM (
    SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END) AS p
    FROM rates, range(200) t(k))),
drawn AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    (CAST('0x' || substr(md5(concat(doc_id, ':{mixing.SEED}:1')), 1, 13) AS BIGINT) + 0.5)
      / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT r, doc_id, drawn.source, count(*) FILTER (c <= u) AS n
  FROM drawn JOIN terms ON drawn.source IS NOT DISTINCT FROM terms.source
  GROUP BY r, doc_id, drawn.source),
copies AS (SELECT doc_id, source, CAST(unnest(range(n)) AS INT) AS copy FROM counted)
SELECT *, CAST('0x' || substr(md5(concat(doc_id, ':', copy, ':{mixing.SEED}-order')), 1, 15) AS BIGINT)
  AS shuffle_key FROM copies
"""



def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# Every level of every tree, the siblings of every leaf, and a CRC-32 by its table.
MERKLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1
      THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
rows AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) % 7 = 0
      THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS changed
  FROM documents, crc),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
roots AS (
  SELECT tree, digest, level FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM roots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM tops WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT l.tree, l.pos, k.level, (l.pos >> CAST(k.level AS INT)) & 1 AS odd, s.digest
  FROM leaves l JOIN roots r USING (tree) JOIN range(64) k(level) ON k.level < r.level
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = k.level AND s.pos = xor(l.pos >> CAST(k.level AS INT), 1)
  UNION ALL
  SELECT l.tree, l.pos, 100 + k.level, (l.tree >> CAST(k.level AS INT)) & 1, s.digest
  FROM leaves l JOIN (SELECT max(level) AS top FROM tops) x ON true JOIN range(64) k(level) ON k.level < x.top
  LEFT JOIN tops s ON s.level = k.level AND s.pos = xor(l.tree >> CAST(k.level AS INT), 1)),
ways AS (
  SELECT tree, pos, string_agg(digest, '' ORDER BY level) AS proof,
    list({{'odd': odd, 'd': coalesce(digest, '')}} ORDER BY level) AS way FROM steps GROUP BY tree, pos),
done AS (
  SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
    sha256(coalesce(w.proof, '')) AS proof_sha256,
    list_reduce([{{'odd': 0::BIGINT, 'd': l.changed}}] || coalesce(w.way, []), lambda a, b: {{'odd': 0::BIGINT,
      'd': sha256(CASE WHEN b.odd = 1 THEN b.d || a.d ELSE a.d || b.d END)}}).d AS folded_root
  FROM leaves l JOIN roots r USING (tree) LEFT JOIN ways w ON w.tree = l.tree AND w.pos = l.pos)
SELECT *, folded_root = root AS verified FROM done
"""

# Failed filters as a mask, counted per source; every order and step looks them up.
AUDIT_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
marked AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < {filter_audit.MIN_WORDS} AS INT)
    + 2 * CAST(100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT} * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.MAX_CAPITALS} * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(d.doc_id > first, false) AS INT) AS mask
  FROM d JOIN firsts USING (text) LEFT JOIN marked ON d.doc_id = marked.doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS bit,
    CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before
  FROM orders, range(1, 6) r(s)),
found AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept,
    sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, {", ".join(
    f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in filter_audit.COUNTS[:-1])},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM found
"""

ORACLES: dict[str, str] = {
    "op5_quality_rules": QUALITY_SQL,
    "op7_source_mix": MIX_SQL,
    "op12_filter_audit": AUDIT_SQL,
    "op13_merkle_manifest": MERKLE_SQL,
}
