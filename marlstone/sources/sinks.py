"""Sinks: JSON lines, a folder a case, and a rewrite that never leaves half a table behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def by_case(df: DataFrame, path: str, case: str = "case_key") -> None:
    """A folder a case; rows of a case are brought together first, so a folder has one file."""
    df.repartition(case).write.partitionBy(case).mode("overwrite").json(path)


def rewrite(df: DataFrame, path: str) -> str:
    """Write beside the old table, then swap names; returns where the old one was kept."""
    spark = df.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.bak"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.delete(p(old), True)
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    return old


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not there yet; returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # the first run has no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = df.select(key).limit(0)
    new = df.dropDuplicates([key]).join(done.distinct(), key, "left_anti").withColumn(key, F.col(key)).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n
