"""Entity resolution, manifests, completeness and other joins of work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import first_filled, token_list


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by an explicit ordinal (ties cannot occur in an ordinal)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pred_gt(pred: DataFrame, gt: DataFrame, split: str | None = None) -> DataFrame:
    """Inner join on slide_id; the split is the true side's."""
    g = gt if split is None else gt.where(F.col("split") == split)
    return pred.drop("split").join(g, "slide_id")


def alias_table(names: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """alias -> row: columns in order of priority, lower-cased base names; a later row overwrites within a column."""
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lower(F.element_at(F.split(F.col(c), "/"), -1)).alias("alias")) for i, c in enumerate(columns)]))
    long = names.select("*", stack.alias("_a")).where("_a.alias is not null and _a.alias <> ''").select("*", "_a.priority", "_a.alias").drop("_a")
    return long.groupBy("alias").agg(F.max_by(F.struct(*names.columns), F.struct(-F.col("priority"), F.col(ordinal))).alias("hit"))


def canonical(items: DataFrame, name: str, aliases: DataFrame, to: str) -> DataFrame:
    """The canonical name, or the base name where no alias is known."""
    base = F.element_at(F.split(F.col(name), "/"), -1)
    keyed = items.withColumn("_alias", F.lower(base))
    return keyed.join(aliases.withColumnRenamed("alias", "_alias"), "_alias", "left").withColumn("canonical", F.coalesce(F.col(f"hit.{to}").cast("string"), base)).drop("_alias", "hit")


def agree(cells: DataFrame, token_case: DataFrame, case_split: DataFrame) -> DataFrame:
    """cells (row_id, cell): the case that all tokens of the cell name, else unmapped; its split where known."""
    tokens = cells.select("row_id", F.explode_outer(token_list(F.col("cell"))).alias("token")).join(token_case, "token", "left")
    one = tokens.groupBy("row_id").agg(F.when((F.count(F.lit(1)) == F.count("case_key")) & (F.count_distinct("case_key") == 1), F.min("case_key")).alias("case_key"))
    out = one.join(case_split, "case_key", "left")
    return out.withColumn("mapped", F.col("split").isNotNull()).select("row_id", "case_key", "split", "mapped")


def restamp(chains: DataFrame, mapping: DataFrame) -> DataFrame:
    """New split where mapped, the old one otherwise; what happened to each row."""
    m = mapping.select("row_id", F.col("split").alias("new_split"))
    out = chains.join(m, "row_id", "left").withColumn("stamped", F.coalesce("new_split", "split"))
    return out.withColumn("change", F.when(F.col("new_split").isNull(), "unmapped").when(F.col("new_split") == F.col("split"), "unchanged").otherwise("flipped"))


def asof_level(requests: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """Exact level, else the greatest below, else the greatest there is."""
    j = requests.join(levels, key)
    pick = F.max_by("level", F.struct(F.col("level") <= F.col("req"), F.col("level")))
    return j.groupBy(key, "req").agg(pick.alias("level"))


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def first_incomplete(expected: DataFrame, present: DataFrame, on: str, idx: str) -> DataFrame:
    """The least index not present, or the number of items if none is missing."""
    gap = missing(expected, present, [on]).agg(F.min(idx).alias("at"))
    return gap.crossJoin(expected.agg(F.count(F.lit(1)).alias("n"))).select(F.coalesce("at", "n").alias("first_incomplete"))


def readiness(items: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """A flag a part, all ready, and the missing parts' names."""
    out = items
    for name, have in parts.items():
        out = out.join(have.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").fillna({f"has_{name}": False})
    flags = [F.when(~F.col(f"has_{n}"), F.lit(n)) for n in parts]
    return out.withColumn("ready", F.expr(" and ".join(f"has_{n}" for n in parts))).withColumn("missing", F.concat_ws(",", *flags))


def presence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids of all sources with a flag a source: a tagged union, the same as full outer joins."""
    out = None
    for name, df in sources.items():
        part = df.select(F.col(key), F.lit(name).alias("_s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(*[F.bool_or(F.col("_s") == n).alias(f"in_{n}") for n in sources])


def route(answers: DataFrame, edges: DataFrame) -> DataFrame:
    """Next node of (node_id, interaction, answer): multi-select prefers the default edge, free text has no other;
    an invalid single or boolean choice is an error, otherwise the walk ends."""
    e = edges.select(F.col("src").alias("node_id"), F.col("answer").alias("_a"), F.col("dst").alias("_d"))
    a = answers.join(e.where("_a <> '__default__'").withColumnsRenamed({"_a": "answer", "_d": "direct"}), ["node_id", "answer"], "left")
    a = a.join(e.where("_a = '__default__'").select("node_id", F.col("_d").alias("fallback")), "node_id", "left")
    single = F.col("interaction").isin("single_select", "boolean")
    nxt = F.when(F.col("interaction") == "multi_select", F.coalesce("fallback", "direct")).when(F.col("interaction") == "free_text", F.col("fallback")).otherwise(F.col("direct"))
    return a.withColumn("next", nxt).withColumn("invalid", single & F.col("direct").isNull()).drop("direct", "fallback")


def resolve_path(items: DataFrame, index: DataFrame, candidates: list[Column], key: str) -> DataFrame:
    """The first candidate name, in order, that the index has."""
    c = items.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("p"), x.alias("name")) for i, x in enumerate(candidates)])).alias("c")).select(key, "c.p", "c.name")
    return items.select(key).join(c.join(index, "name").groupBy(key).agg(F.min_by("name", "p").alias("path")), key, "left")


def manifest(rows: DataFrame) -> DataFrame:
    """Cases from slides (case_id, slide, ord, label, duplicate): ordered slide list, the last filled label of rows
    that are no duplicates, the number of slides."""
    filled = (F.coalesce(F.col("label"), F.lit("")) != "") & ~F.col("duplicate")
    return rows.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "slide"))), lambda s: s["slide"].cast("string")), ",").alias("slide_ids"), F.max_by(F.when(filled, F.col("label")), F.when(filled, F.col("ord"))).alias("label"), F.count(F.lit(1)).alias("n_slides"), F.min("ord").alias("first_ord"))


def severity_pick(candidates: DataFrame) -> DataFrame:
    """The slide of the gravest diagnosis a case, ties to slide order; candidates: case_key, pos, slide_id, diagnosis.
    A stored pick counts if it is a candidate."""
    # fixed values: the severity of a diagnosis
    ranks = {"malignant": 5, "premalignant": 4, "benign": 3, "non_neoplastic": 2, "non-neoplastic": 2, "reactive": 2, "descriptive": 1}
    d = F.lower(F.trim(F.coalesce("diagnosis", F.lit(""))))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), d), F.lit(0))
    c = candidates.withColumn("rank", rank)
    stored = F.max(F.when(F.col("stored_pick") == F.col("slide_id"), F.col("slide_id"))) if "stored_pick" in candidates.columns else F.lit(None).cast("string")
    best = F.max_by("slide_id", F.struct(F.col("rank"), -F.col("pos")))
    return c.groupBy("case_key").agg(F.coalesce(stored, best).alias("chosen"), F.max("rank").alias("rank"), F.when(stored.isNotNull(), "stored").otherwise("severity_fallback").alias("method"))


def status_counts(expected: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """done > failed > missing a stage."""
    m = markers.groupBy(key).agg(F.bool_or(F.col("state") == "done").alias("done"), F.bool_or(F.col("state") == "failed").alias("failed"))
    j = expected.join(m, key, "left")
    state = F.when(F.col("done"), "done").when(F.col("failed"), "failed").otherwise("missing")
    return j.withColumn("status", state)


def pick_report(*cols: Column) -> Column:
    return first_filled(*[F.trim(c) for c in cols])


def train_test(rows: DataFrame, key: str, most: int = 70) -> DataFrame:
    """A split by hashed order: min(most, max(1, n div 3)) rows are test."""
    w = Window.orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return rows.withColumn("r", F.row_number().over(w)).withColumn("split", F.when(F.col("r") <= F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / 3))), "test").otherwise("train")).drop("r")
