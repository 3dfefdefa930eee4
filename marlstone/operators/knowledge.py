"""The knowledge graph from passages' triples, numbering at scale, and the choice between its ways of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import kg_edges
from marlstone.sources.scratch import folder


def numbered(rows: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """0.. in an order over all rows, without one task for all: ranges are numbered inside, then moved by the counts of
    the ranges before. The ranges are written first, as they must not be drawn twice."""
    spark = rows.sparkSession
    path = folder(spark, "numbered")
    own = Window.partitionBy("_range").orderBy(*order)
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))
    return kept.withColumn("_place", F.row_number().over(own) - 1).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def phrases(triples: DataFrame) -> DataFrame:
    """(phrase, idx): distinct subjects and objects by first appearance; triples has passage, pos, sub, rel, obj."""
    each = triples.select(F.explode(F.array(F.struct(F.col("sub").alias("phrase"), "passage", "pos", F.lit(0).alias("side")), F.struct(F.col("obj").alias("phrase"), "passage", "pos", F.lit(1).alias("side")))).alias("e"))
    first = each.groupBy("e.phrase").agg(F.min(F.struct("e.passage", "e.pos", "e.side")).alias("at")).select("phrase", "at.*")
    return numbered(first, F.col("passage"), F.col("pos"), F.col("side"), F.col("phrase")).select("phrase", "idx")


def build(triples: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, type, label) of all triples: phrases are ``h<idx>``, passages ``p<passage>``; synonyms pairs of
    phrases (a, b)."""
    ids = phrases(triples)
    as_node = lambda df, col: df.join(ids.select(F.col("phrase").alias(col), F.concat(F.lit("h"), F.col("idx").cast("string")).alias("_n")), col).drop(col).withColumnRenamed("_n", col)
    t = as_node(as_node(triples, "sub"), "obj")
    held = t.select(F.concat(F.lit("p"), F.col("passage").cast("string")).alias("passage"), F.explode(F.array("sub", "obj")).alias("phrase")).distinct()
    pairs = as_node(as_node(synonyms, "a"), "b") if synonyms is not None else None
    return kg_edges(t.select(F.col("sub").alias("subj"), "rel", "obj"), held, pairs)


def seeds(candidates: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """From (query_id, pos, sub, obj, sim, keep): the ``top`` triples a query, of them those kept by the filter, and the
    ``top`` phrases by mean similarity (query_id, phrase, score). Also the queries where none was kept."""
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("pos").desc(), "sub", "obj")
    best = candidates.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    phrase = best.where("keep").select("query_id", F.explode(F.array("sub", "obj")).alias("phrase"), "sim").groupBy("query_id", "phrase").agg(F.avg("sim").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "phrase")
    phrase = phrase.withColumn("r", F.row_number().over(by)).where(F.col("r") <= top).drop("r")
    return phrase, candidates.select("query_id").distinct().join(phrase, "query_id", "left_anti")


def passages(dense: DataFrame, walked: DataFrame, unseeded: DataFrame, excluded: Column, k: int) -> DataFrame:
    """The ``k`` best passages a query (query_id, passage, score, way): by walked scores, or by dense similarity where no
    triple was left; those of the excluded case are passed over, not counted."""
    both = dense.join(unseeded, "query_id", "left_semi").withColumn("way", F.lit("dense")).unionByName(walked.join(unseeded, "query_id", "left_anti").withColumn("way", F.lit("graph")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "passage")
    return both.where(~excluded).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
