"""Tiles and coordinates of large images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microns per pixel of an objective, zoom aliases and the runtime menu.
MPP = {"1x": 10.0, "1.25x": 8.0, "2.5x": 4.0, "4x": 2.5, "5x": 2.0, "10x": 1.0, "20x": 0.5, "40x": 0.25}
ALIASES = {"4x": "5x", "low": "5x", "medium": "10x", "high": "20x", "ultra": "40x"}
MENU = ("10x", "20x", "40x")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_zoom(z: Column) -> Column:
    key = F.trim(F.replace(F.lower(z), F.lit("×"), F.lit("x")))
    return F.coalesce(F.try_element_at(_map(ALIASES), key), key)


def clamp_zoom(z: Column, default: str = "20x") -> Column:
    n = normalize_zoom(z)
    return F.when(n.isin(*MENU), n).otherwise(default)


def downsample(z: Column, slide_mpp: Column) -> Column:
    return F.element_at(_map(MPP), normalize_zoom(z)) / F.coalesce(slide_mpp, F.lit(0.25))


def recentre(x: Column, y: Column, size_from: Column, size_to: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Top-left of a crop of another size about the same centre, kept on the slide; halves round to even."""
    def one(a: Column, full: Column) -> Column:
        c = (a + size_from / 2).cast("long")
        return F.greatest(F.lit(0), F.least(F.bround(c - size_to / 2, 0).cast("long"), F.greatest(F.lit(0), full - size_to)))

    return one(x, width), one(y, height)


def tile_grid(slides: DataFrame, step: int | None = None) -> DataFrame:
    """Row-major top-left corners; slides has slide_id, width, height, patch."""
    s = F.lit(step) if step else F.col("patch")
    axis = lambda full: F.sequence(F.lit(0).cast("long"), F.greatest(full - F.col("patch") + 1, F.lit(1)) - 1, s.cast("long"))
    rows = slides.withColumn("y", F.explode(axis(F.col("height")))).withColumn("x", F.explode(axis(F.col("width"))))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("slide_id").orderBy("y", "x")) - 1)


def tissue_fraction(tiles: DataFrame, cells: DataFrame, least: float = 0.4, block: int = 64) -> DataFrame:
    """Share of tissue mask cells in a tile's box (bounds cut to whole cells, clipped); empty boxes give 0.

    tiles: slide_id, tile_id, mx0, my0, mx1, my1 in mask cells; cells: slide_id, mx, my, v. The range join is an
    equi-join on blocks of cells."""
    b = lambda c: F.floor(F.col(c) / block)
    spread = tiles.where("mx1 > mx0 and my1 > my0").withColumn("bx", F.explode(F.sequence(b("mx0"), F.floor((F.col("mx1") - 1) / block)))).withColumn("by", F.explode(F.sequence(b("my0"), F.floor((F.col("my1") - 1) / block))))
    c = cells.withColumns({"bx": b("mx"), "by": b("my")})
    inside = spread.join(c, ["slide_id", "bx", "by"]).where("mx >= mx0 and mx < mx1 and my >= my0 and my < my1")
    share = inside.groupBy("slide_id", "tile_id").agg(F.avg((F.col("v") > 0).cast("double")).alias("frac"))
    out = tiles.join(share, ["slide_id", "tile_id"], "left").withColumn("frac", F.round(F.coalesce("frac", F.lit(0.0)), 6))
    return out.withColumn("tissue", F.col("frac") >= least)


def stratified_sample(coords: DataFrame, k: int, rows: int = 8, cols: int = 8, patch: int = 0) -> DataFrame:
    """Exactly min(k, n) coordinates of each slide with even cover of a grid; coords has slide_id, ord, x, y."""
    half = max(patch // 2, 1)
    by = Window.partitionBy("slide_id")
    c = coords.withColumns({"n": F.count(F.lit(1)).over(by), "x0": F.min("x").over(by), "x1": F.max("x").over(by), "y0": F.min("y").over(by), "y1": F.max("y").over(by)})
    g = lambda v, lo, hi, cells: F.least(F.floor((F.col(v) + half - (F.col(lo) + half)).cast("double") / F.greatest((F.col(hi) - F.col(lo)).cast("double"), F.lit(1.0)) * cells), F.lit(cells - 1))
    c = c.withColumns({"gx": g("x", "x0", "x1", cols), "gy": g("y", "y0", "y1", rows)})
    c = c.withColumn("cell", F.dense_rank().over(by.orderBy("gy", "gx")) - 1)
    c = c.withColumns({"cells": F.max("cell").over(by) + 1, "m": F.count(F.lit(1)).over(Window.partitionBy("slide_id", "cell")), "r": F.row_number().over(Window.partitionBy("slide_id", "cell").orderBy("ord")) - 1})
    c = c.withColumn("quota", F.floor(F.lit(k) / F.col("cells")) + F.when(F.col("cell") < F.lit(k) % F.col("cells"), 1).otherwise(0))
    step = F.greatest(F.floor(F.col("m") / F.greatest(F.col("quota"), F.lit(1))), F.lit(1))
    first = (F.col("n") <= k) | ((F.col("quota") > 0) & ((F.col("quota") >= F.col("m")) | ((F.col("r") % step == 0) & (F.floor(F.col("r") / step) < F.col("quota")))))
    c = c.withColumn("first", first)
    c = c.withColumn("need", k - F.sum(F.col("first").cast("int")).over(by))
    c = c.withColumns({"left": F.sum((~F.col("first")).cast("int")).over(by), "lr": F.row_number().over(Window.partitionBy("slide_id", "first").orderBy("ord")) - 1})
    more = F.greatest(F.floor(F.col("left") / F.greatest(F.col("need"), F.lit(1))), F.lit(1))
    top_up = (~F.col("first")) & (F.col("need") > 0) & (F.col("lr") % more == 0) & (F.floor(F.col("lr") / more) < F.col("need"))
    return c.where(F.col("first") | top_up).select("slide_id", "ord", "x", "y")


def encode_policy(n: Column, threshold: int = 1024, cap: int = 4096) -> Column:
    return F.when(n == 0, "empty").when((n <= threshold) | (n <= cap), "full").otherwise("stratified")


def parent_of(children: DataFrame, parents: DataFrame, child: int, parent: int) -> DataFrame:
    """The parent tile that holds the child's centre, first by index; else the nearest by centre. Containment is an
    equi-join on the parent grid's cells; only children without a container meet all parents of their slide."""
    c = children.withColumns({"cx": F.col("x") + child // 2, "cy": F.col("y") + child // 2})
    p = parents.select("slide_id", F.col("idx").alias("pidx"), F.col("x").alias("px"), F.col("y").alias("py"))
    grid = p.withColumn("gx", F.explode(F.sequence(F.floor(F.col("px") / parent), F.floor((F.col("px") + parent - 1) / parent)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("py") / parent), F.floor((F.col("py") + parent - 1) / parent))))
    at = c.withColumns({"gx": F.floor(F.col("cx") / parent), "gy": F.floor(F.col("cy") / parent)})
    held = at.join(grid, ["slide_id", "gx", "gy"]).where(f"cx >= px and cx < px + {parent} and cy >= py and cy < py + {parent}").groupBy("slide_id", "idx").agg(F.min("pidx").alias("pidx"))
    lost = c.join(held, ["slide_id", "idx"], "left_anti").join(p, "slide_id")
    d = (F.col("cx") - F.col("px") - parent / 2.0) * (F.col("cx") - F.col("px") - parent / 2.0) + (F.col("cy") - F.col("py") - parent / 2.0) * (F.col("cy") - F.col("py") - parent / 2.0)
    near = lost.groupBy("slide_id", "idx").agg(F.min_by("pidx", F.struct(d, F.col("pidx"))).alias("pidx"))
    return held.withColumn("contained", F.lit(True)).unionByName(near.withColumn("contained", F.lit(False)))


def hsv_mask(pixels: DataFrame, sat_min: float = 0.08, val_max: float = 0.95, close: int = 3) -> DataFrame:
    """Tissue by saturation and value, then a morphological close (dilate, erode) by window functions: a square's
    maximum is the row maximum of column maxima. Outside counts 0 when dilating and 1 when eroding. Pixels must fill
    their rows and columns."""
    hi, lo = F.greatest("r", "g", "b") / 255.0, F.least("r", "g", "b") / 255.0
    sat = F.when(hi > 1e-6, (hi - lo) / (hi + 1e-8)).otherwise(0.0)
    m = pixels.withColumn("raw", ((F.round(sat, 9) >= sat_min) & (F.round(hi, 9) <= val_max)).cast("int"))
    k = close // 2
    row, col = Window.partitionBy("slide_id", "y").orderBy("x").rowsBetween(-k, k), Window.partitionBy("slide_id", "x").orderBy("y").rowsBetween(-k, k)
    for f in (F.max, F.min):
        m = m.withColumn("m", f("m" if "m" in m.columns else "raw").over(row)).withColumn("m", f("m").over(col))
    return m.select("slide_id", "x", "y", "raw", F.col("m").alias("mask"))
