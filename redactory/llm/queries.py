"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm import langid, quality
from redactory.llm.bpe import encode_documents
from redactory.llm.common import read_documents
from redactory.llm.decontam import find_contamination
from redactory.llm.hardneg import hard_negatives
from redactory.llm.linededup import dedup_lines
from redactory.llm.lmscore import score_documents
from redactory.llm.neardup import near_duplicates
from redactory.llm.ngramjoin import ngram_components
from redactory.llm.rules import judge
from redactory.llm.runs import find_runs, repeat_tail
from redactory.llm.sharding import row_size, shuffle_into_shards
from redactory.llm.tokencount import EditPattern, count_tokens


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(read_documents(spark, sf_dir), 24)
    return out.select(
        "doc_id",
        row_size(F.col("text")).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, toxic = (quality.co_train(docs, labels, label) for label in ("quality", "toxic"))
    return quality.score(docs, model, toxic=toxic).select("doc_id", "quality_score", "toxic_score", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_removed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), (F.col("text") != "").alias("kept"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(read_documents(spark, sf_dir), items)


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), words=3, num=85, den=100)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: What op10 edits out: e-mail addresses, long digit runs and tripled marks.
EDIT = [("@", r"(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+"), ("", r"\d(?:[ -]?\d){6,}"), ("*", r"\*{3}"), ("%", "%{3}"), ("&", "&{3}"), ("#", "#{3}"), ("$", r"\${3}")]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), texts=False, find=EditPattern(EDIT))
    return out.select("doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_reencoded")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(read_documents(spark, sf_dir).select("doc_id", "text"), replace=repeat_tail, texts=False)
    return out.drop("runs", "collapsed")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_documents(spark, sf_dir).select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {}

SQL["op9_quality_rules"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
e AS (SELECT r, generate_subscripts(ws, 1) AS p, unnest(ws) AS x FROM w),
g AS (SELECT r, p, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o] AS g FROM e WINDOW o AS (PARTITION BY r ORDER BY p)),
d AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g[5] IS NOT NULL),
h AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nx FROM d WHERE n > 1),
k AS (SELECT r, sum(least(5, coalesce(nx - p, 5))) AS n_repeat_words FROM h GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
f AS (SELECT doc_id, text, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN k USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS upper_,
  length(text) - length(replace(text, '|', '')) AS bars,
  len(list_filter(list_zip(ws[2:], ws[:-2]), lambda x: x[1] = x[2])) AS echoes FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > n_words) OR upper_ * 2 > letters OR letters * 2 < word_chars
    OR bars * 10 > n_words OR echoes * 10 > n_words * 3) AS kept
FROM v
"""

SQL["op13_hard_negatives"] = r"""
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
