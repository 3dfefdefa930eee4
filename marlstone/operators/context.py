"""Window operators over the steps of a case (case, pos, node_id, question, answer, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What tells that a step found a tumour, and answers that say it did not.
TUMOR = ("mass", "carcinoma", "tumor", "sarcoma", "malignan")
NOT_TUMOR = ("none_benign", "none_of_above", "not_applicable", "unsure", "atypia_only")


def _order(case: str = "case") -> Window:
    return Window.partitionBy(case).orderBy("pos")


def prior_context(steps: DataFrame, last: int | None = None, sep: str = "; ") -> DataFrame:
    """``id=answer`` of the earlier steps that have both, all of them or the last few."""
    said = F.when((F.coalesce("node_id", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""), F.concat_ws("=", "node_id", "answer"))
    w = _order().rowsBetween(Window.unboundedPreceding if last is None else -last, -1)
    return steps.withColumn("context", F.array_join(F.collect_list(said).over(w), sep))


def next_question(steps: DataFrame) -> DataFrame:
    return steps.withColumn("next_question", F.lead("question", 1, "").over(_order()))


def localizes(node: Column, answer: Column) -> Column:
    a = F.lower(F.coalesce(answer, F.lit("")))
    said = F.concat_ws(" ", F.lower(node), a)
    hit = F.lit(False)
    for t in TUMOR:
        hit = hit | said.contains(t)
    return hit & ~a.isin(*NOT_TUMOR)


def latest_anchor(steps: DataFrame, coord: str = "coord") -> DataFrame:
    """The coordinate of the latest earlier step that localizes a tumour."""
    w = _order().rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("anchor", F.last(F.when(localizes(F.col("node_id"), F.col("answer")), F.col(coord)), ignorenulls=True).over(w))


def retry_best(attempts: DataFrame, threshold: float = 0.65, most: int = 2) -> DataFrame:
    """attempts (case, node_id, attempt, answer or null, confidence): the surest valid answer up to the first that
    reaches the threshold, of at most ``most`` attempts."""
    key = ["case", "node_id"]
    a = attempts.where(F.col("attempt") <= most)
    stop = F.min(F.when(F.col("answer").isNotNull() & (F.col("confidence") >= threshold), F.col("attempt"))).over(Window.partitionBy(*key))
    seen = a.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop"))).where("answer is not null")
    return seen.groupBy(*key).agg(F.max_by("answer", F.struct(F.col("confidence"), -F.col("attempt"))).alias("answer"), F.max("confidence").alias("confidence"))


def strided_pick(rows: DataFrame, by: str, order: str, quota: int) -> DataFrame:
    """Every n-th row of a group, up to the quota."""
    w = Window.partitionBy(by)
    r = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(order)) - 1})
    step = F.greatest(F.floor(F.col("_n") / quota), F.lit(1))
    return r.where((F.col("_r") % step == 0) & (F.floor(F.col("_r") / step) < quota)).drop("_n", "_r")


def linspace_pick(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """k evenly spaced rows of a group, first and last included."""
    w = Window.partitionBy(by)
    r = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(order)) - 1})
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(k - 1, 1)).cast("int"))
    return r.where(F.array_contains(at, F.col("_r"))).drop("_n", "_r")


def reindex(rows: DataFrame, number: str, name: str) -> DataFrame:
    """0.. by number (missing last), then name. An order over all rows is one task; work lists are small."""
    return rows.withColumn("idx", F.row_number().over(Window.orderBy(F.coalesce(F.col(number), F.lit(10**9)), name)) - 1)


def inner_loop(script: DataFrame, most: int = 3) -> DataFrame:
    """Iterations of a node's loop from a script (case, node_id, iter, patch_ids, sufficient): runs until one suffices
    or the budget ends; the patches seen before are what the next iteration excludes."""
    key = Window.partitionBy("case", "node_id")
    stop = F.min(F.when(F.col("sufficient"), F.col("iter"))).over(key)
    run = script.where(F.col("iter") < most).withColumn("_s", stop).where(F.col("_s").isNull() | (F.col("iter") <= F.col("_s"))).drop("_s")
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("patch_ids").over(key.orderBy("iter").rowsBetween(Window.unboundedPreceding, -1)))))
    return run.withColumn("excluded", seen)


def branch_reason(*conds: tuple[Column, str]) -> Column:
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for c, n in conds])
