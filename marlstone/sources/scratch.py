"""Where intermediate files go: the shared folder of the session, a temporary one only where that is unset."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
