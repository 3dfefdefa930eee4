"""Answers taken from reports node by node, the walk they make, and its record."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import resolve_answer, strip
from marlstone.operators import resolve as R

MAX_STEPS = 64
#: What an abstention becomes, in order.
ABSTENTIONS = ("unsure", "none_of_above", "not_mentioned")


def fallback_answer(raw: Column, options: Column, default: Column) -> Column:
    """For ``not_mentioned``: the first abstention among the options, else the node's default if it is an option."""
    said = strip(F.lower(F.trim(F.coalesce(raw, F.lit(""))))) == "not_mentioned"
    have = [F.when(F.array_contains(options, F.lit(a)), F.lit(a)) for a in ABSTENTIONS]
    return F.when(said, F.coalesce(*have, F.when(F.array_contains(options, default), default)))


def extracted(attempts: list[Column], options: Column, edges: Column, interaction: Column, default: Column) -> Column:
    """Of the attempts in turn (the call and its retry): the answer as the node knows it, else its fallback; null is an error."""
    return F.coalesce(*[c for raw in attempts for c in (resolve_answer(raw, options, edges, interaction), fallback_answer(raw, options, default))])


def walk(answers: DataFrame, nodes: DataFrame, edges: DataFrame, root: str, most: int = MAX_STEPS) -> DataFrame:
    """All cases from the root by their answers (case, node_id, answer; null: none could be taken), with the routing of
    every interaction: default edges for multi-select and free text, an error for a choice without an edge.

    A row a step: case, depth, node_id, answer, status. The last step's status tells how the walk ended: ``end`` (no next
    node, or the next is the report), ``cycle``, ``no_answer``, ``invalid`` or ``too_long``; the others are ``step``."""
    spark = answers.sparkSession
    kinds = nodes.select(F.col("id").alias("node_id"), "interaction", "is_leaf")
    hop = R.route(answers.join(F.broadcast(kinds), "node_id"), edges)
    leaf = nodes.where("is_leaf").select(F.col("id").alias("next"), F.lit(True).alias("to_leaf"))
    hop = hop.join(F.broadcast(leaf), "next", "left")
    how = F.when(F.col("answer").isNull(), "no_answer").when(F.col("invalid"), "invalid").when(F.col("next").isNull() | F.col("to_leaf") | F.col("is_leaf"), "end").otherwise("step")
    name = f"_hops_{uuid.uuid4().hex}"
    hop.select("case", "node_id", "answer", how.alias("how"), "next").createOrReplaceTempView(name)
    try:
        out = spark.sql(f"""
            WITH RECURSIVE w(case, depth, node_id, path) AS (
              SELECT DISTINCT case, 0, '{root}', array('{root}') FROM {name}
              UNION ALL
              SELECT w.case, w.depth + 1, h.next, array_append(w.path, h.next) FROM w JOIN {name} h ON h.case = w.case AND h.node_id = w.node_id
              WHERE h.how = 'step' AND w.depth < {most} AND NOT array_contains(slice(w.path, 1, size(w.path) - 1), w.node_id))
            SELECT w.case, w.depth, w.node_id, h.answer,
              CASE WHEN w.depth >= {most} THEN 'too_long' WHEN array_contains(slice(w.path, 1, size(w.path) - 1), w.node_id) THEN 'cycle'
                WHEN h.how IS NULL THEN 'no_answer' ELSE h.how END AS status
            FROM w LEFT JOIN {name} h ON h.case = w.case AND h.node_id = w.node_id""")
        out.schema  # resolved here, so the view may go
        return out
    finally:
        spark.catalog.dropTempView(name)


def chain_records(steps: DataFrame, reports: DataFrame) -> DataFrame:
    """A record a case from walked steps (case, depth, node_id, question, answer, status) and (case, split, report): the
    chain, its path, the report, extraction_status and, where the walk failed, the error."""
    good = F.col("status").isin("step", "end")
    item = F.struct("depth", F.struct("node_id", "question", "answer").alias("s"))
    by = steps.groupBy("case").agg(F.array_sort(F.collect_list(F.when(good, item))).alias("all"), F.max_by("status", "depth").alias("last"), F.max_by("node_id", "depth").alias("at"))
    chain = F.transform("all", lambda x: x["s"])
    bad = ~F.col("last").isin("step", "end")
    return by.join(reports, "case").select(
        F.col("case").alias("slide_id"), "split", chain.alias("chain"), F.transform(chain, lambda s: s["node_id"]).alias("node_path"), "report",
        F.when(bad, "failed").otherwise("ok").alias("extraction_status"), F.when(bad, F.concat_ws(" at ", "last", "at")).alias("error"),
    )
