"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, language_id, line_dedup, lm_score, mixing, packing, quality, simhash, token_counts
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.where("conv_id is not null").groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(F.lit(0).alias("_"))
    pairs = ids.select("pair_id", (2 * F.col("pair_id")).alias("chosen"), (2 * F.col("pair_id") + 1).alias("rejected"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = chat.format_preferences(turns, pairs)
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


OP2_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
x AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         a.i IS NOT NULL AND b.i IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n_common FROM x GROUP BY pair_id),
r AS (
  SELECT t.pair_id, t.side, t.i, t.role, n.n_common,
         '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS turn_text
  FROM t JOIN n ON t.pair_id = n.pair_id),
s AS (
  SELECT *, sum(length(turn_text)) OVER (PARTITION BY pair_id, side ORDER BY i) AS till FROM r WHERE i > n_common)
SELECT n.pair_id, CAST(n.n_common AS INT) AS n_common,
  coalesce((SELECT string_agg(turn_text, '' ORDER BY i) FROM r WHERE r.pair_id = n.pair_id AND side = 0 AND i <= n.n_common), '') AS prompt,
  coalesce((SELECT string_agg(turn_text, '' ORDER BY i) FROM s WHERE s.pair_id = n.pair_id AND side = 0), '') AS chosen,
  coalesce((SELECT string_agg(turn_text, '' ORDER BY i) FROM s WHERE s.pair_id = n.pair_id AND side = 1), '') AS rejected,
  coalesce((SELECT string_agg(CAST(till - length(turn_text) + length(head) AS BIGINT) || '-' || CAST(till AS BIGINT), ',' ORDER BY i) FROM s WHERE s.pair_id = n.pair_id AND side = 0 AND role = 'assistant'), '') AS chosen_spans,
  coalesce((SELECT string_agg(CAST(till - length(turn_text) + length(head) AS BIGINT) || '-' || CAST(till AS BIGINT), ',' ORDER BY i) FROM s WHERE s.pair_id = n.pair_id AND side = 1 AND role = 'assistant'), '') AS rejected_spans
FROM n
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_chunks", "n_removed"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, md5(line) AS h FROM l),
e AS (
  SELECT *, lead(i) OVER t IS NULL OR n > 50 OR lead(n) OVER t > 50
    OR coalesce(CAST('0x' || substr(md5(lag(h) OVER t || h), 1, 2) AS INT) < 85, false) AS stop
  FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM e),
c AS (
  SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY i) AS chunk, sum(CAST(n > 0 AS INT)) >= 2 OR max(n) > 50 AS fit FROM k GROUP BY doc_id, idx),
r AS (SELECT *, fit AND row_number() OVER (PARTITION BY fit, chunk ORDER BY doc_id, idx) > 1 AS gone FROM c),
o AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '') AS rest, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE rest END AS text,
  CAST(coalesce(n_chunks, 0) AS INT) AS n_chunks, CAST(coalesce(n_removed, 0) AS INT) AS n_removed
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), derive=lambda ids: {"ids_crc32": F.crc32(ids)})


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS vec_id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.root, e.vec_id) AS component_id, e.vec_id = coalesce(c.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 returns, less the verdict of its method, which SQL can't express."""
    return op6_quality_rules(spark, sf_dir).drop("kept", "score")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (
  SELECT doc_id, i, lead(word, 4) OVER t IS NOT NULL AS whole,
    word || ' ' || lead(word, 1) OVER t || ' ' || lead(word, 2) OVER t || ' ' || lead(word, 3) OVER t || ' ' || lead(word, 4) OVER t AS five
  FROM u WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g WHERE whole),
k AS (SELECT DISTINCT doc_id, i + j AS i FROM t, range(5) AS x(j) WHERE n >= 2),
s AS (SELECT doc_id, count(*) AS n_repeat_words FROM k GROUP BY doc_id),
a AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
FROM a
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 returns, less the words taken, which are random; targets are rounded."""
    return op10_mixing(spark, sf_dir).drop("taken").withColumn("target", F.round("target", 4))


TARGET_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(3 AS DOUBLE) * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS k FROM s),
l AS (
  SELECT k, cap / w AS most,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM o),
x AS (SELECT level FROM l WHERE level <= most ORDER BY k LIMIT 1)
SELECT d.doc_id, d.size, o.source_size, round(least(o.cap, o.w * (SELECT level FROM x)), 4) AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def queries() -> dict:
    own = (op1_language_id, op2_chat_format, op3_line_dedup, op4_best_fit_packing, op5_embedding_dedup, op6_quality_rules, op7_token_counts, op8_simhash, op9_lm_score, op10_mixing, quality_base_counts, mixing_targets)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "quality_base_counts": BASE_SQL, "mixing_targets": TARGET_SQL}
