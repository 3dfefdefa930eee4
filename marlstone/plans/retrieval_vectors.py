"""Vector retrieval and tile geometry queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import geometry as G
from marlstone.operators import vectors as R
from marlstone.plans.base import pool, table, vector_queries

POOL = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS slide_id, (vec_id % 32) * 512 AS x, (vec_id // 32) * 512 AS y FROM embeddings), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, (vec_id % 32) * 512 AS qx, (vec_id // 32) * 512 AS qy FROM embeddings)"
COS = "round(list_inner_product(v, qv) / ((sqrt(list_inner_product(v, v)) + 1e-8) * (sqrt(list_inner_product(qv, qv)) + 1e-8)), 6)"
SCORED = f"{POOL}, s AS (SELECT query_id, id, slide_id, x, y, qx, qy, {COS} AS sim FROM p, q)"


def _top(where="", by="query_id", k=5, extra=""):
    return f"WITH {SCORED}{extra} SELECT query_id, id, sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sim DESC, id) AS rank FROM s {where}) WHERE rank <= {k}"


def _centres(spark, sf):
    p = pool(spark, sf)
    return p, R.representatives(p, R.mean_pool(p, "slide_id"), "slide_id")


def similar_pairs(spark, sf):
    return R.similar_pairs(pool(spark, sf), 0.45).select("id_a", "id_b", "sim")


def mean_pool_by_label(spark, sf):
    m = R.mean_pool(pool(spark, sf), "slide_id")
    return m.select("slide_id", F.posexplode("mean").alias("pos", "v")).select("slide_id", "pos", F.round("v", 6).alias("v"))


def nearest_centroid(spark, sf):
    return _centres(spark, sf)[1].select("slide_id", "id", "d", "members")


def diverse_topk(spark, sf):
    return R.diverse_nearest(pool(spark, sf), vector_queries(spark, sf), 1024.0, 5)


def cosine_topk(spark, sf):
    return R.nearest(pool(spark, sf), vector_queries(spark, sf), 5).select("query_id", "id", "sim", "rank")


def cosine_topk_per_label(spark, sf):
    return R.nearest(pool(spark, sf), vector_queries(spark, sf), 3, by="slide_id").select("query_id", "slide_id", "id", "sim", "rank")


def cosine_topk_excluding(spark, sf):
    def unseen(asked, given):
        q, p = asked.column("query_id").to_numpy()[:, None], given.column("id").to_numpy()[None, :]
        return (p != q) & (p != q + 10) & (p != 7)

    return R.nearest(pool(spark, sf), vector_queries(spark, sf), 5, keep=unseen).select("query_id", "id", "sim", "rank")


def _away(spark, sf, least):
    return R.nearest(pool(spark, sf), vector_queries(spark, sf), 5, keep=lambda asked, given: R.distances(asked, given) >= least).select("query_id", "id", "sim", "rank")


def anchor_min_distance_topk(spark, sf):
    return _away(spark, sf, 2048.0)


def anchor_relax_topk(spark, sf):
    far = _away(spark, sf, 30000.0)
    return far.union(_away(spark, sf, 15000.0).join(far.select("query_id").distinct(), "query_id", "left_anti"))


def representative_pool_topk(spark, sf):
    p, reps = _centres(spark, sf)
    return R.nearest(p.join(reps.select("id").distinct(), "id", "left_semi"), vector_queries(spark, sf), 3).select("query_id", "id", "sim", "rank")


def kmeans_sizes(spark, sf):
    got, _ = R.kmeans(pool(spark, sf), 8)
    return got.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def _slides(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("slide_id"), (2000 + F.col("n_nationkey") * 300).cast("long").alias("width"), (1500 + F.col("n_nationkey") * 200).cast("long").alias("height"), F.lit(512).cast("long").alias("patch"))


def tile_grid(spark, sf):
    return G.tile_grid(_slides(spark, sf)).select("slide_id", "ord", "x", "y")


def tissue_fraction(spark, sf):
    tiles = G.tile_grid(_slides(spark, sf)).select("slide_id", F.col("ord").alias("tile_id"), *[F.floor(e).cast("long").alias(n) for n, e in (("mx0", F.col("x") / 64), ("my0", F.col("y") / 64), ("mx1", F.least((F.col("x") + 512) / 64, F.floor(F.col("width") / 64))), ("my1", F.least((F.col("y") + 512) / 64, F.floor(F.col("height") / 64))))])
    s = _slides(spark, sf)
    cells = s.withColumn("mx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("width") / 64) - 1))).withColumn("my", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("height") / 64) - 1)))
    cells = cells.select("slide_id", "mx", "my", F.when((F.col("mx") * 7 + F.col("my") * 13 + F.col("slide_id")) % 5 < 2, 255).otherwise(0).alias("v"))
    return G.tissue_fraction(tiles, cells).select("slide_id", "tile_id", "frac", "tissue")


def _coords(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("slide_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7919 % 40000).alias("x"), (F.col("o_orderkey") * 104729 % 30000).alias("y"))


def stratified_sample(spark, sf):
    return G.stratified_sample(_coords(spark, sf), 100, 4, 4, 512)


def encode_policy(spark, sf):
    n = _coords(spark, sf).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return n.withColumn("policy", G.encode_policy(F.col("n"), 100, 200))


def zoom_recentre(spark, sf):
    p = pool(spark, sf).withColumn("zoom", F.element_at(F.array(*map(F.lit, ("low", "10×", "high", "40x", "2.5x"))), (F.col("id") % 5 + 1).cast("int")))
    p = p.withColumns({"zoom_key": G.normalize_zoom(F.col("zoom")), "menu": G.clamp_zoom(F.col("zoom")), "ds": G.downsample(F.col("zoom"), F.lit(0.25))})
    x, y = G.recentre(F.col("x"), F.col("y"), F.lit(512), F.bround(F.lit(256) * F.col("ds"), 0).cast("long"), F.lit(16384), F.lit(32768))
    return p.select("id", "zoom_key", "menu", "ds", x.alias("x1"), y.alias("y1"))


def parent_tiles(spark, sf):
    p = pool(spark, sf).select("slide_id", F.col("id").alias("idx"), "x", "y")
    parents = p.where("idx % 3 = 0").select("slide_id", "idx", (F.floor(F.col("x") / 1024) * 1024).alias("x"), (F.floor(F.col("y") / 1024) * 1024).alias("y"))
    return G.parent_of(p, parents, 512, 1024).select("slide_id", "idx", "pidx", "contained")


def grandparent_chain(spark, sf):
    p = pool(spark, sf).select("slide_id", F.col("id").alias("idx"), "x", "y")
    grid = lambda s: p.select("slide_id", (F.floor(F.col("x") / s) * s).alias("x"), (F.floor(F.col("y") / s) * s).alias("y")).distinct().withColumn("idx", F.row_number().over(Window.partitionBy("slide_id").orderBy("y", "x")) - 1)
    mid, top = grid(1024), grid(4096)
    a, b = G.parent_of(p, mid, 512, 1024).select("slide_id", "idx", F.col("pidx").alias("parent")), G.parent_of(mid, top, 1024, 4096).select("slide_id", F.col("idx").alias("parent"), F.col("pidx").alias("grandparent"))
    return a.join(b, ["slide_id", "parent"], "left").select("slide_id", "idx", "parent", "grandparent")


def hsv_mask(spark, sf):
    e = table(spark, sf, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("slide_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(11))))
    px = e.select("slide_id", "x", "y", ((F.col("x") * 37 + F.col("y") * 11) % 256).alias("r"), ((F.col("x") * 29 + F.col("slide_id") * 50) % 256).alias("g"), ((F.col("y") * 53 + 20) % 256).alias("b"))
    return G.hsv_mask(px)


_SLIDES = "s AS (SELECT n_nationkey::BIGINT AS slide_id, 2000 + n_nationkey * 300 AS w, 1500 + n_nationkey * 200 AS h FROM nation), g AS (SELECT slide_id, w, h, x, y, row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1 AS ord FROM (SELECT slide_id, w, h, unnest(range(0, greatest(w - 512 + 1, 1), 512)) AS x, h AS hh FROM s) JOIN (SELECT slide_id AS s2, unnest(range(0, greatest(h - 512 + 1, 1), 512)) AS y FROM s) ON slide_id = s2)"
_C = "c AS (SELECT o_custkey % 7 AS slide_id, o_orderkey AS ord, o_orderkey * 7919 % 40000 AS x, o_orderkey * 104729 % 30000 AS y FROM orders)"
ORACLES = {
    "cosine_topk": _top(),
    "cosine_topk_per_label": _top(by="query_id, slide_id", k=3).replace("SELECT query_id, id", "SELECT query_id, slide_id, id"),
    "cosine_topk_excluding": _top("WHERE id NOT IN (query_id, query_id + 10, 7)"),
    "anchor_min_distance_topk": _top("WHERE sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) >= 2048"),
    "anchor_relax_topk": f"WITH {SCORED}, d AS (SELECT *, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d FROM s), b AS (SELECT query_id, CASE WHEN bool_or(d >= 30000) THEN 30000 ELSE 15000 END AS lim FROM d GROUP BY query_id) SELECT query_id, id, sim, CAST(rank AS INT) AS rank FROM (SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY sim DESC, id) AS rank FROM d JOIN b ON d.query_id = b.query_id WHERE d.d >= lim) WHERE rank <= 5",
    "similar_pairs": f"WITH {POOL}, n AS (SELECT id, v, sqrt(list_inner_product(v, v)) + 1e-8 AS n FROM p) SELECT a.id AS id_a, b.id AS id_b, round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) AS sim FROM n a JOIN n b ON a.id < b.id WHERE round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) >= 0.45",
    "mean_pool_by_label": "SELECT label AS slide_id, CAST(pos AS INT) AS pos, round(avg(v), 6) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL",
    "nearest_centroid": "WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS m FROM e GROUP BY ALL), d AS (SELECT e.label, vec_id, round(sum((v - m) * (v - m)), 6) AS d FROM e JOIN m ON e.label = m.label AND e.pos = m.pos GROUP BY ALL) SELECT label AS slide_id, vec_id AS id, d, members FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r, count(*) OVER (PARTITION BY label) AS members FROM d) WHERE r = 1",
    "tile_grid": f"WITH {_SLIDES} SELECT slide_id, CAST(ord AS INT) AS ord, x::BIGINT AS x, y::BIGINT AS y FROM g",
    "tissue_fraction": f"WITH {_SLIDES}, t AS (SELECT slide_id, ord, x // 64 AS a, y // 64 AS b, least((x + 512) // 64, w // 64) AS c, least((y + 512) // 64, h // 64) AS d FROM g), m AS (SELECT slide_id, mx, my, CASE WHEN (mx * 7 + my * 13 + slide_id) % 5 < 2 THEN 1.0 ELSE 0.0 END AS v FROM (SELECT slide_id, h, unnest(range(0, w // 64)) AS mx FROM s) JOIN (SELECT slide_id AS s2, unnest(range(0, h // 64)) AS my FROM s) ON slide_id = s2) SELECT t.slide_id, CAST(ord AS INT) AS tile_id, round(coalesce(avg(v), 0), 6) AS frac, round(coalesce(avg(v), 0), 6) >= 0.4 AS tissue FROM t LEFT JOIN m ON t.slide_id = m.slide_id AND mx >= a AND mx < c AND my >= b AND my < d GROUP BY t.slide_id, ord",
    "encode_policy": f"WITH {_C} SELECT slide_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) <= 200 THEN 'full' ELSE 'stratified' END AS policy FROM c GROUP BY slide_id",
    "zoom_recentre": f"WITH {POOL}, z AS (SELECT id, x, y, ['5x', '10x', '20x', '40x', '2.5x'][id % 5 + 1] AS zoom_key, [8.0, 4.0, 2.0, 1.0, 16.0][id % 5 + 1]::DOUBLE AS ds FROM p) SELECT id, zoom_key, CASE WHEN zoom_key IN ('10x', '20x', '40x') THEN zoom_key ELSE '20x' END AS menu, ds, greatest(0, least(x + 256 - (256 * ds)::BIGINT // 2, greatest(0, 16384 - (256 * ds)::BIGINT)))::BIGINT AS x1, greatest(0, least(y + 256 - (256 * ds)::BIGINT // 2, greatest(0, 32768 - (256 * ds)::BIGINT)))::BIGINT AS y1 FROM z",
    "parent_tiles": f"WITH {POOL}, c AS (SELECT slide_id, id AS idx, x + 256 AS cx, y + 256 AS cy FROM p), t AS (SELECT slide_id, id AS pidx, x // 1024 * 1024 AS px, y // 1024 * 1024 AS py FROM p WHERE id % 3 = 0), j AS (SELECT c.slide_id, idx, pidx, (cx >= px AND cx < px + 1024 AND cy >= py AND cy < py + 1024) AS contained, (cx - px - 512.0) * (cx - px - 512.0) + (cy - py - 512.0) * (cy - py - 512.0) AS d FROM c JOIN t ON c.slide_id = t.slide_id) SELECT slide_id, idx, pidx, contained FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, idx ORDER BY NOT contained, CASE WHEN contained THEN 0 ELSE d END, pidx) AS r FROM j) WHERE r = 1",
    "grandparent_chain": f"WITH {POOL}, m AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1 AS idx FROM (SELECT DISTINCT slide_id, x // 1024 * 1024 AS x, y // 1024 * 1024 AS y FROM p)), t AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1 AS idx FROM (SELECT DISTINCT slide_id, x // 4096 * 4096 AS x, y // 4096 * 4096 AS y FROM p)) SELECT p.slide_id, p.id AS idx, CAST(m.idx AS INT) AS parent, CAST(t.idx AS INT) AS grandparent FROM p LEFT JOIN m ON p.slide_id = m.slide_id AND p.x // 1024 * 1024 = m.x AND p.y // 1024 * 1024 = m.y LEFT JOIN t ON p.slide_id = t.slide_id AND p.x // 4096 * 4096 = t.x AND p.y // 4096 * 4096 = t.y",
    "hsv_mask": "WITH e AS (SELECT n_nationkey AS slide_id, x, y, (x * 37 + y * 11) % 256 AS r, (x * 29 + n_nationkey * 50) % 256 AS g, (y * 53 + 20) % 256 AS b FROM nation, (SELECT unnest(range(0, 16)) AS x), (SELECT unnest(range(0, 12)) AS y) WHERE n_nationkey < 4), m AS (SELECT slide_id, x, y, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo FROM e), w AS (SELECT slide_id, x, y, CASE WHEN round(CASE WHEN hi > 1e-6 THEN (hi - lo) / (hi + 1e-8) ELSE 0 END, 9) >= 0.08 AND round(hi, 9) <= 0.95 THEN 1 ELSE 0 END AS raw FROM m), d AS (SELECT a.slide_id, a.x, a.y, max(b.raw) AS v FROM w a JOIN w b ON a.slide_id = b.slide_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL), f AS (SELECT a.slide_id, a.x, a.y, min(b.v) AS v FROM d a JOIN d b ON a.slide_id = b.slide_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL) SELECT w.slide_id, CAST(w.x AS INT) AS x, CAST(w.y AS INT) AS y, raw, v AS mask FROM w JOIN f USING (slide_id, x, y)",
}
ORACLES["representative_pool_topk"] = f"WITH {SCORED}, r AS ({ORACLES['nearest_centroid']}) SELECT query_id, id, sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE id IN (SELECT id FROM r)) WHERE rank <= 3"
ORACLES["stratified_sample"] = f"""WITH {_C}, g AS (SELECT *, count(*) OVER s AS n, least(floor((x - min(x) OVER s)::DOUBLE / greatest(max(x) OVER s - min(x) OVER s, 1) * 4), 3) AS gx, least(floor((y - min(y) OVER s)::DOUBLE / greatest(max(y) OVER s - min(y) OVER s, 1) * 4), 3) AS gy FROM c WINDOW s AS (PARTITION BY slide_id)),
 k AS (SELECT *, dense_rank() OVER (PARTITION BY slide_id ORDER BY gy, gx) - 1 AS cell, row_number() OVER (PARTITION BY slide_id, gy, gx ORDER BY ord) - 1 AS r, count(*) OVER (PARTITION BY slide_id, gy, gx) AS m FROM g),
 q AS (SELECT *, 100 // (max(cell) OVER s + 1) + CASE WHEN cell < 100 % (max(cell) OVER s + 1) THEN 1 ELSE 0 END AS quota FROM k WINDOW s AS (PARTITION BY slide_id)),
 f AS (SELECT *, n <= 100 OR (quota > 0 AND (quota >= m OR (r % greatest(m // greatest(quota, 1), 1) = 0 AND r // greatest(m // greatest(quota, 1), 1) < quota))) AS first FROM q),
 t AS (SELECT *, 100 - count(*) FILTER (first) OVER (PARTITION BY slide_id) AS need, count(*) FILTER (NOT first) OVER (PARTITION BY slide_id) AS rest, row_number() OVER (PARTITION BY slide_id, first ORDER BY ord) - 1 AS lr FROM f)
 SELECT slide_id, ord, x, y FROM t WHERE first OR (need > 0 AND lr % greatest(rest // greatest(need, 1), 1) = 0 AND lr // greatest(rest // greatest(need, 1), 1) < need)"""
_NAMES = "cosine_topk cosine_topk_per_label cosine_topk_excluding anchor_min_distance_topk anchor_relax_topk representative_pool_topk similar_pairs mean_pool_by_label nearest_centroid diverse_topk kmeans_sizes tile_grid tissue_fraction stratified_sample encode_policy zoom_recentre parent_tiles grandparent_chain hsv_mask".split()
QUERIES = {n: globals()[n] for n in _NAMES}
