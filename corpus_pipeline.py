"""Documents to training files: quality rules, near-duplicate removal, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, mixing, ngram_join, quality_rules, token_files
from marlstone.llm.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = "_other_columns"


def _packed(docs: DataFrame) -> DataFrame:
    """Columns beyond those of documents as one, so that none clashes with what an operator adds."""
    more = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*more).alias(REST)) if more else docs


def _unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(c) if c in COLUMNS else F.col(REST)[c].alias(c) for c in columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are among them. Repeated rows are judged alike."""
    return _unpacked(quality_rules.apply_policy(quality_rules.ledger(_packed(docs)), "v1").where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one of the least id; documents without an id stand behind
    those that have one. Rows are keyed by id and text, so texts that share an id are documents of their own; of rows
    equal in both the one of the least hash stays. Null and empty texts are like nothing but a repeat of their own row."""
    rows = _packed(docs)
    keyed = rows.withColumns({"_key": F.xxhash64("doc_id", "text"), "_row": F.xxhash64(*rows.columns)})
    groups = ngram_join.similar(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "group_id").distinct()
    named = groups.join(keyed.groupBy("_key", "doc_id").agg(F.min("_row").alias("_row")), "_key")
    least = named.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "_row")).alias("m"))
    stay = least.select("m._key", F.col("m._row").alias("_least"))
    return _unpacked(keyed.join(stay, "_key").where(F.col("_row") == F.col("_least")).dropDuplicates(["_key"]), docs.columns)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows are judged alike."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is there as often as it is drawn, or not at all. Null and empty
    texts weigh nothing and go with their block; each of several equal rows is drawn by itself."""
    mixed = mixing.mix(_packed(docs)).where("copies > 0")
    return _unpacked(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and their documents as read back; a null text is its end id alone."""
    return token_files.read(token_files.write(docs, token_files.new_folder(spark)))


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("decontamination", clean_of_tests), ("mixing", mixture), ("token_files", tokens)]
ORACLE_SQL = None  # hashed shingles, draws and a tokenizer are not SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
