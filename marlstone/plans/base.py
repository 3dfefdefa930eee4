"""Tables and the stand-ins that the plans share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches: a slide is a label; coordinates lie on a grid of 512."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("slide_id"), (F.col("vec_id") % 32 * 512).alias("x"), (F.floor(F.col("vec_id") / 32) * 512).alias("y"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a query, with its place on the grid."""
    p = pool(spark, sf_dir)
    return p.select(F.col("id").alias("query_id"), F.col("vec").alias("query"), F.col("x").alias("qx"), F.col("y").alias("qy"))
