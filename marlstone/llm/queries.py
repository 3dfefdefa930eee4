"""One query an operator, over its whole table, and the SQL oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import byte_model, decontaminate, html_extract, language_id, mixing, ngram_join, quality_classifier, quality_rules, repeats, token_files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_docs(spark, sf_dir))


def op5_byte_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_model.score(_docs(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(_docs(spark, sf_dir), keep=("doc_id",)), "v1")
    failed_base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE_MASK)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed_base.alias("base_failed"), "kept", "failed")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
g AS (SELECT rid, p, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
h AS (SELECT *, (c IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, b, c) > 1) AS twice FROM g),
k AS (SELECT *, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS inside FROM h WINDOW o AS (PARTITION BY rid ORDER BY p)),
m AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words,
  count(*) FILTER (regexp_matches(w, '\p{L}')) AS n_letter, count(*) FILTER (w = upper(w) AND w <> lower(w) AND length(w) > 1) AS n_cap,
  count(*) FILTER (length(w) > 40) AS n_long FROM k GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
n AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_letter, 0) AS n_letter, coalesce(n_cap, 0) AS n_cap, coalesce(n_long, 0) AS n_long
  FROM d LEFT JOIN m USING (rid) LEFT JOIN n USING (rid)),
f AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
  + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
  + 64 * (100 * n_letter < 60 * n_words)::INT + 128 * (100 * n_cap > 60 * n_words)::INT + 256 * (100 * n_long > 20 * n_words)::INT AS failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::INT AS failed FROM f
"""

def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_docs(spark, sf_dir).select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir), carry=False).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "shards", "positions")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_docs(spark, sf_dir), token_files.new_folder(spark)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_extract": op3_html_extract,
    "op4_repeats": op4_repeats,
    "op5_byte_model": op5_byte_model,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op7_quality_rules": OP7_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
