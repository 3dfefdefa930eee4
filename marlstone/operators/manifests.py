"""Work lists from spreadsheets, name maps and files: which column, which source, which item, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_column(df: DataFrame, *names: str) -> Column:
    """The first of the names that the table has; an error if it has none."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of the columns {', '.join(names)} is there")


def parts(t: Column) -> Column:
    """The comma-separated parts that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def manifest(sheet: DataFrame, case: tuple[str, ...], slides: tuple[str, ...], split: Column) -> DataFrame:
    """(case_id, slide_ids, n_slides, split) of the rows that name a case and a slide."""
    s = parts(first_column(sheet, *slides).cast("string"))
    out = sheet.select(F.trim(first_column(sheet, *case).cast("string")).alias("case_id"), F.array_join(s, ",").alias("slide_ids"), F.size(s).alias("n_slides"), split.alias("split"))
    return out.where((F.col("case_id") != "") & (F.col("n_slides") > 0))


def name_map_counts(names: DataFrame, case: str = "case_key", duplicate: str = "report_duplicate") -> DataFrame:
    """One row: slides, distinct cases that have a key, rows whose report is a duplicate."""
    return names.agg(F.count(F.lit(1)).alias("slides"), F.count_distinct(F.nullif(F.col(case), F.lit(""))).alias("cases"), F.count_if(F.col(duplicate) == "1").alias("duplicates"))


def first_source(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any, with its place in the list."""
    out = None
    for i, df in enumerate(sources):
        part = df.withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(out.agg(F.min("source").alias("source"))), "source", "left_semi")


def pick(rows: DataFrame, index: int, *order: str) -> DataFrame:
    """The row at a place of the order; an error beyond its end. Only the rows up to the place are sorted out."""
    got = rows.orderBy(*order).limit(index + 1)
    n = got.count()
    if not 0 <= index < n:
        raise IndexError(f"index {index} is out of range: {rows.count()} rows")
    return got.orderBy(*[F.col(c).desc() for c in order]).limit(1)


def file_index(files: DataFrame, suffix: str = ".svs") -> DataFrame:
    """(name, path): of equal names the path found first."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower("path").endswith(suffix)).groupBy(name.alias("name")).agg(F.min("path").alias("path"))


def present(items: DataFrame, index: DataFrame, slides: str = "slide_id") -> DataFrame:
    """``items`` with whether any of their comma-separated slides is in the index."""
    each = items.select(slides, F.explode(parts(F.col(slides))).alias("name")).distinct()
    have = each.join(index.select("name"), "name", "left_semi").select(slides).distinct().withColumn("present", F.lit(True))
    return items.join(have, slides, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def usable(records: DataFrame, split: str = "") -> DataFrame:
    """Records to train on: extraction went well, the split is the one asked for, the chain has steps."""
    out = records.where((F.coalesce("extraction_status", F.lit("ok")) == "ok") & (F.coalesce("slide_id", F.lit("")) != "") & (F.size("chain") > 0))
    return out.where(F.col("split") == split) if split else out


def section_mismatch(found: DataFrame, expected: DataFrame, letter: str = "letter") -> DataFrame:
    """(letter, problem): expected sections that were not found, and others that were."""
    f, e = found.select(letter).distinct().withColumn("f", F.lit(1)), expected.select(letter).distinct().withColumn("e", F.lit(1))
    both = f.join(e, letter, "full_outer").where("f is null or e is null")
    return both.select(letter, F.when(F.col("f").isNull(), "missing").otherwise("unexpected").alias("problem"))


def gate(stages: DataFrame, wanted: DataFrame, stage: str) -> DataFrame:
    """``wanted`` (slide_id) with whether the stage is verified, so that what comes after may run, and why not."""
    ok = stages.where(F.col("stage") == stage).groupBy("slide_id").agg(F.bool_or("verified").alias("v"))
    return wanted.join(ok, "slide_id", "left").select("slide_id", F.coalesce("v", F.lit(False)).alias("may_run"), F.when(F.col("v").isNull(), "not run").when(~F.col("v"), "not verified").alias("reason"))


def missing_of_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, missing): all slides of a case without a record, in order; cases that lack none are not there."""
    each = cases.select("case_id", F.posexplode(parts(F.col("slide_ids"))).alias("pos", "slide_id"))
    lost = each.join(records.select("slide_id").distinct(), "slide_id", "left_anti")
    return lost.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slide_id"))), lambda s: s["slide_id"]), ",").alias("missing"))


def level_use(steps: DataFrame, images: DataFrame, k: int = 3) -> DataFrame:
    """(level, nodes, images): along the steps (case, node_id, slide_id, level), nodes that use a level and the images
    (slide_id, level, rank) of it they are shown, at most ``k`` a node."""
    n = images.where(F.col("rank") < k).groupBy("slide_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return steps.join(n, ["slide_id", "level"], "left").groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.coalesce("n", F.lit(0))).alias("images"))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait before an attempt (1 first), doubling up to a bound."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def batch_status(wanted: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names in order with the status of their run: as recorded last, or ``todo``."""
    last = done.groupBy(name).agg(F.max_by(F.struct("status", "error"), "at").alias("r"))
    return wanted.select(name).distinct().join(last, name, "left").select(name, F.coalesce("r.status", F.lit("todo")).alias("status"), F.col("r.error").alias("error"))

