"""Structured Streaming: windows and sessions with watermarks, resumable appends, episodic state of a case."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events, one file or a folder of them; the zone-less time becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a stream takes a single file only from a pattern
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and type; on a stream a closed window is emitted once."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows, from files beside the checkpoint."""
    if mode != "append":
        raise ValueError("only rows that are final can be drained to files")
    spark, out = stream.sparkSession, f"{checkpoint}/rows"
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def append_resumable(stream: DataFrame, out: str, checkpoint: str, per_batch: int = 10) -> None:
    """Append rows in bounded micro-batches as JSON lines; the checkpoint makes a rerun go on where it ended."""
    stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).option("maxFilesPerTrigger", per_batch).trigger(availableNow=True).start().awaitTermination()


def skip_seen(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """A micro-batch without what is already done, each key once."""
    return batch.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


EPISODE = T.StructType([T.StructField("case", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("context", T.StringType())])
#: Characters of contexts after which a case's rows go on as a frame of their own.
EPISODE_CHARS = 4 << 20


def episodic(steps: DataFrame) -> DataFrame:
    """Append-only memory of a case (columns case, pos, node_id, answer): each step gets the earlier findings. A batch's
    rows of a case are held at once: it comes in frames cut anywhere, in no order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    state = T.StructType([T.StructField("said", T.StringType())])

    def step(key, frames, held):
        import pandas as pd

        said = held.get[0] if held.exists else ""
        whole = pd.concat(list(frames)).sort_values("pos", kind="stable")
        rows, size = [], 0
        for pos, node, answer in zip(whole["pos"].tolist(), whole["node_id"].tolist(), whole["answer"].tolist()):
            rows.append((key[0], pos, said))
            size += len(said)
            if node and answer:
                said = f"{said}; {node}={answer}" if said else f"{node}={answer}"
            if size > EPISODE_CHARS:
                yield pd.DataFrame(rows, columns=EPISODE.names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=EPISODE.names)
        held.update((said,))

    return steps.groupBy("case").applyInPandasWithState(step, EPISODE, state, "append", GroupStateTimeout.NoTimeout)
