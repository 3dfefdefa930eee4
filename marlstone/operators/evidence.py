"""What a node asks for and gets: retrieval text, policies, ancestors, visual evidence by method, selection records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("thumbnail", "none", "patch_retrieve", "slide_embed")
#: The coarser zoom beside which a patch is shown.
PARENT_ZOOM = {"40x": "20x", "20x": "10x", "10x": "5x"}


def needs_patches(policy: Column) -> Column:
    return F.coalesce(policy.isin("patch_retrieve", "both"), F.lit(False))


def with_grandparent(tier: Column, kind: Column, enabled: bool = True) -> Column:
    """Whether a second ancestor is shown: for integration tiers, and integration and report nodes."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.lit(enabled) & ((low(tier) == "integration") | low(kind).isin("integration", "report"))


def parent_zoom(zoom: Column, enabled: bool = True) -> Column:
    """The parent's zoom, null at the coarsest level or where ancestors are switched off."""
    table = F.create_map(*[F.lit(x) for pair in PARENT_ZOOM.items() for x in pair])
    return F.get(F.array(F.try_element_at(table, zoom)), 0) if enabled else F.lit(None).cast("string")


def retrieval_text(question: Column, description: Column) -> Column:
    """Question and description, the description only if there is one."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.trim(F.concat_ws(" ", filled(question), F.nullif(filled(description), F.lit(""))))


def enriched(tier: Column, question: Column, query: Column) -> Column:
    return F.trim(F.concat(F.lit("["), tier, F.lit("] "), question, F.lit(" "), query))


def should_retry(confidence: Column, least: float = 0.65) -> Column:
    return confidence < least


def is_tissue(pixels: Column, background: int = 220) -> Column:
    """Whether the mean of gray values (an array) is no brighter than the background."""
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels) <= background


#: Tasks that slides are dealt to: a task with few slides repeats few values, which columnar files write once.
SLIDE_TASKS = 256


def evidence(asked: DataFrame, cache: DataFrame, patches: DataFrame, k: int = 3, form=lambda paths: paths) -> DataFrame:
    """A row a row of ``asked`` (slide_id, node_id, method, policy): what its provider hands over. ``cache`` has slide_id,
    thumbnail, embedding (null where missing), ``patches`` slide_id, rank, path. Every provider but ``none`` shows the
    thumbnail; ``patch_retrieve`` adds patches where the node's policy asks for them; ``slide_embed`` adds the embedding's
    width and the first ``k`` patches. A slide without a cache gets an empty bundle; an unknown method is an error.
    ``form`` makes of an array of paths what ``paths`` shows, once a slide."""
    of = patches.groupBy("slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"]).alias("_paths"))
    first = of.select("slide_id", form(F.col("_paths")).alias("_all"), F.size("_paths").alias("_n"), form(F.slice("_paths", 1, k)).alias("_first"), F.least(F.size("_paths"), F.lit(k)).alias("_k"))
    rows = asked.repartition(SLIDE_TASKS, "slide_id").join(cache, "slide_id", "left").join(first, "slide_id", "left")
    known = F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise(F.raise_error(F.concat(F.lit("unknown visual provider: "), F.coalesce("method", F.lit("null")))).cast("string"))
    rows = rows.withColumn("method", known)
    none = F.array().cast("array<string>")
    whole, part = (F.col("method") == "patch_retrieve") & needs_patches(F.col("policy")), F.col("method") == "slide_embed"
    shown = F.coalesce(F.when(whole, F.col("_all")).when(part, F.col("_first")), form(none))
    n = F.coalesce(F.when(whole, F.col("_n")).when(part, F.col("_k")), F.lit(0))
    return rows.select(
        "slide_id",
        "node_id",
        "method",
        F.when(F.col("method") != "none", F.col("thumbnail")).alias("thumbnail"),
        F.when((F.col("method") == "slide_embed") & F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_dim"),
        shown.alias("paths"),
        n.alias("n_paths"),
    )


def selection_record(case_key: Column, slides: Column, chosen: Column, rationale: Column, method: Column, skipped: Column) -> Column:
    """The metadata of a selection; skipped slides only if there are any."""
    return F.struct(case_key.alias("case_key"), slides.alias("physical_slides"), chosen.alias("chosen_slide_id"), rationale.alias("rationale"), method.alias("selection_method"), F.lit("ss_llm_pick").alias("fusion"), F.when(F.size(skipped) > 0, skipped).alias("skipped_slides"))
