"""Records, prompts and exports: what stages hand to each other as text or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import first_filled


def flatten_evidence(patches: DataFrame, scales: tuple[str, ...] = ("patch", "parent", "grandparent")) -> DataFrame:
    """A row a (patch, scale) that has a path, in rank and scale order."""
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("scale"), F.col(f"{s}_path").alias("path")) for i, s in enumerate(scales)])
    keep = [c for c in patches.columns if not c.endswith("_path")]
    return patches.select(*keep, F.explode(F.filter(items, lambda x: x["path"].isNotNull() & (x["path"] != ""))).alias("s")).select(*keep, "s.scale", "s.path", (F.col("rank") * len(scales) + F.col("s.i")).alias("ord"))


def without_report(chain: Column) -> Column:
    return F.filter(chain, lambda s: s["node_id"] != "report")


def report_of(chain: Column, report: Column, given: Column) -> Column:
    """A given report beats the chain's, which beats the answer of a last report step."""
    last = F.element_at(chain, -1)
    return F.coalesce(first_filled(given, report), F.when(F.size(chain) > 0, F.when(last["node_id"] == "report", last["answer"])), F.lit(""))


def eval_record(chains: DataFrame) -> DataFrame:
    """slide_id, node_path (of the steps, else the stored one), steps and report."""
    ids = F.filter(F.transform("chain", lambda s: s["node_id"]), lambda x: x.isNotNull() & (x != ""))
    return chains.select("slide_id", F.when(F.size(ids) > 0, ids).otherwise(F.coalesce("node_path", F.array().cast("array<string>"))).alias("node_path"), "chain", report_of(F.col("chain"), F.col("report"), F.lit(None).cast("string")).alias("report"))


def chain_text(chain: Column, report: Column) -> Column:
    lines = F.transform(chain, lambda s: F.concat(s["node_id"], F.lit(": "), s["question"], F.lit(" -> "), s["answer"]))
    return F.array_join(F.concat(lines, F.when(F.trim(report) != "", F.array(F.concat(F.lit("Per-slide report: "), F.trim(report)))).otherwise(F.array().cast("array<string>"))), "\n")


def selection_prompt(cands: DataFrame) -> DataFrame:
    """One prompt a case from its candidates (case_key, pos, slide_id, text), in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "slide_id", "text"))), lambda s: F.concat(F.lit("## Slide "), s["slide_id"], F.lit("\n"), s["text"]))
    return cands.groupBy("case_key").agg(F.concat(F.lit("Select the case-level chain from these candidates:\n\n"), F.array_join(parts, "\n\n")).alias("prompt"))


def sections(*parts: Column) -> Column:
    """Filled parts with an empty line between."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def visual_note(patches: Column, thumbnails: Column) -> Column:
    return F.when((patches == 0) & (thumbnails == 0), "").otherwise(F.concat_ws(", ", F.when(thumbnails > 0, F.format_string("%d thumbnail(s)", thumbnails)), F.when(patches > 0, F.format_string("%d patch(es)", patches))))


def format_hits(hits: DataFrame) -> DataFrame:
    """One text a query: a header line and the body of each hit in rank order, separated."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))), lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), s["title"], F.lit("\n"), s["text"]))
    return hits.groupBy("query_id").agg(F.array_join(one, "\n---\n").alias("context"))


def chat_sample(system: Column, user: Column, target: Column) -> Column:
    """A chat sample as JSON."""
    m = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(m("system", system), m("user", user), m("assistant", target)).alias("messages")))


def training_samples(steps: DataFrame) -> DataFrame:
    """A sample a choice step with an answer: earlier findings as context. Skipped steps count as findings."""
    w = Window.partitionBy("case").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("answer") != "", F.concat_ws("=", "node_id", "answer"))
    s = steps.withColumn("episodic_context", F.array_join(F.collect_list(said).over(w), "; "))
    return s.where(F.col("interaction").isin("single_select", "multi_select", "boolean") & (F.col("answer") != ""))


def selected(response: Column, candidates: Column, fallback: Column) -> Column:
    """The id a selector's JSON names if it is a candidate, else the fallback."""
    chosen = F.trim(F.get_json_object(response, "$.slide_id"))
    return F.when(F.array_contains(candidates, chosen), chosen).otherwise(fallback)


def paired_anchor(earlier: Column, own_first: Column, iteration: Column) -> Column:
    """Earlier tumour evidence, else the node's own best patch from the second iteration on."""
    return F.coalesce(earlier, F.when(iteration >= 1, own_first))


def magnification(mpp: Column, downsample: Column) -> Column:
    return F.round(0.5 / (mpp * downsample) * 20, 3)


def spread_labels(points: DataFrame, gap: float) -> DataFrame:
    """Labels of a bin pushed down to a least gap, in y order: a running maximum."""
    w = Window.partitionBy("bin").orderBy("y", "id")
    n = points.withColumn("_i", F.row_number().over(w))
    return n.withColumn("placed", F.round(F.max(F.col("y") - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * gap, 6)).drop("_i")


def consistency_break(steps: DataFrame) -> DataFrame:
    """Steps that speak of invasion, and not of none, after an earlier answer of no invasion."""
    w = Window.partitionBy("case").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    a = F.lower(F.coalesce("answer", F.lit("")))
    s = steps.withColumn("_none", F.coalesce(F.max(a.contains("no invasion")).over(w), F.lit(False)))
    return s.withColumn("inconsistent", F.col("_none") & a.contains("invasion") & ~a.contains("no ")).drop("_none")


def consistent_counts(vectors: DataFrame, coords: DataFrame, key: str) -> DataFrame:
    """Groups whose vectors and coordinates differ in number."""
    a, b = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("vectors")), coords.groupBy(key).agg(F.count(F.lit(1)).alias("coords"))
    return a.join(b, key, "full").fillna(0, ["vectors", "coords"]).where("vectors <> coords")
