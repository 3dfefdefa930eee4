"""Vector retrieval over pools of patches: exact top-k and its constraints. Queries are a table, usually small.

Pools are read once; the query side is broadcast only after its rows were counted (``small``). Per-query top-k goes
through row_number() <= k, which Spark cuts in each task before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.sources.scratch import shared

BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def similarities(pool: DataFrame, queries: DataFrame, on: list[str] | None = None) -> DataFrame:
    """pool (id, vec, ...) against queries (query_id, query): a stated query set against all rows."""
    p = pool.withColumn("_n", V.norm(F.col("vec")))
    q = small(queries.withColumn("_q", V.norm(F.col("query"))))
    both = p.join(q, on) if on else p.crossJoin(q)
    return both.withColumn("sim", F.round(V.cosine(F.col("vec"), F.col("query"), F.col("_n"), F.col("_q")), 6)).drop("_n", "_q")


def rank(scored: DataFrame, by: list[str], k: int | Column | None, score: str = "sim", tie: str = "id") -> DataFrame:
    """Ranks 1..k in each group by score, ties by id; k may be a column."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def topk(pool: DataFrame, queries: DataFrame, k: int, exclude: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """Top-k a query; ``exclude`` has (query_id, id) pairs that are left out, ``within`` the ids of a restricted pool."""
    if within is not None:
        pool = pool.join(within.select("id").distinct(), "id", "left_semi")
    scored = similarities(pool, queries)
    if exclude is not None:
        scored = scored.join(exclude, ["query_id", "id"], "left_anti")
    return rank(scored, ["query_id"], max(1, k))


def away_from(scored: DataFrame, least: float, relax: bool = True, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows whose distance (column d) is at least ``least``; if none of a query is, half of that, once."""
    any_far = F.bool_or(F.col("d") >= least).over(Window.partitionBy(*by))
    bound = F.when(any_far, F.lit(least)).otherwise(F.lit(least / 2)) if relax else F.lit(least)
    return scored.withColumn("_b", bound).where(F.col("d") >= F.col("_b")).drop("_b")


def diverse(ranked: DataFrame, spacing: float, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Greedy in rank order: a row is taken if it is farther than ``spacing`` from all taken; one group is a bounded pool."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "x", "y", "sim")))
    none = F.filter(F.col("all"), lambda r: F.lit(False))

    def step(taken: Column, r: Column) -> Column:
        far = F.forall(taken, lambda t: (t["x"] - r["x"]) * (t["x"] - r["x"]) + (t["y"] - r["y"]) * (t["y"] - r["y"]) > spacing * spacing)
        return F.when((F.size(taken) < k) & far, F.array_append(taken, r)).otherwise(taken)

    out = ranked.groupBy(*by).agg(rows.alias("all")).select(*by, F.posexplode(F.aggregate("all", none, step)).alias("_i", "r"))
    return out.select(*by, (F.col("_i") + 1).alias("rank"), "r.id", "r.x", "r.y", "r.sim")


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _unit(table: pa.Table, name: str) -> np.ndarray:
    m = np.stack(_numpy(table, name)).astype(np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + V.EPS)


def _best(asked: pa.Table, given: pa.Table, k: int, by: str | None, keep, columns: list[str]) -> pa.Table:
    """The k best rows of a tile for each of its queries (and value of ``by``), ties by id."""
    given = given.sort_by("id")
    n, width = asked.num_rows, given.num_rows
    sim = np.rint(_unit(asked, "query") @ _unit(given, "vec").T * 1e6).astype(np.int64) if n and width else np.zeros((n, width), np.int64)
    key = sim * width + np.arange(width - 1, -1, -1)
    least = np.iinfo(np.int64).min
    if keep is not None and n and width:
        key[~keep(asked, given)] = least
    label = _numpy(given, by) if by else np.zeros(width, np.int64)
    q, p = [], []
    for v in np.unique(label):
        at = np.flatnonzero(label == v)
        part, some = key[:, at], min(k, len(at))
        top = np.argpartition(part, len(at) - some, axis=1)[:, len(at) - some :]
        i, j = np.nonzero(np.take_along_axis(part, top, axis=1) > least)
        q.append(i)
        p.append(at[top[i, j]])
    q, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (q, p))
    rows = given.take(pa.array(p))
    return pa.table({"query_id": asked.column("query_id").take(pa.array(q))} | {c: rows.column(c) for c in columns} | {"sim": sim[q, p] / 1e6})


def nearest(pool: DataFrame, queries: DataFrame, k: int, by: str | None = None, keep=None, block_rows: int = 2048) -> DataFrame:
    """Top-k of many queries (query_id, query, ...) against all rows (id, vec, ...): blocks of both sides meet in
    tiles, one matrix product a tile, and a tile keeps its k best a query. ``by`` is a pool column whose values are
    ranked apart; ``keep(queries, rows)`` gives a tile's allowed pairs as a matrix."""
    a, b = (max(1, -(-df.count() // block_rows)) for df in (pool, queries))
    deal = lambda df, key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = pool.withColumn("_i", deal(pool, "id", a)).withColumn("_j", every(b))
    asks = queries.withColumn("_j", deal(queries, "query_id", b)).withColumn("_i", every(a))
    columns = [c for c in pool.columns if c != "vec"]
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"`{c}` {pool.schema[c].dataType.simpleString()}" for c in columns), "sim double"])

    def tile(asked: pa.Table, given: pa.Table) -> pa.Table:
        return _best(asked, given, k, by, keep, columns)

    found = asks.groupBy("_i", "_j").cogroup(rows.groupBy("_i", "_j")).applyInArrow(tile, schema)
    return rank(found, ["query_id", by] if by else ["query_id"], k)


def distances(asked: pa.Table, given: pa.Table) -> np.ndarray:
    """Of a tile's queries (qx, qy) from its rows (x, y)."""
    dx, dy = (_numpy(asked, f"q{v}")[:, None].astype(np.float64) - _numpy(given, v)[None, :] for v in ("x", "y"))
    return np.sqrt(dx * dx + dy * dy)


def diverse_nearest(pool: DataFrame, queries: DataFrame, spacing: float, k: int) -> DataFrame:
    """``diverse`` over the whole order of every query: k rounds, each takes the best row that is farther than
    ``spacing`` from all taken before. Only the taken rows are kept between rounds."""
    shared(pool.sparkSession)

    def far(asked: pa.Table, given: pa.Table) -> np.ndarray:
        x, y = _numpy(given, "x")[None, :], _numpy(given, "y")[None, :]
        ok = np.ones((asked.num_rows, given.num_rows), bool)
        for tx, ty in zip(np.stack(_numpy(asked, "tx")).T, np.stack(_numpy(asked, "ty")).T):
            ok &= (x - tx[:, None]) ** 2 + (y - ty[:, None]) ** 2 > spacing * spacing
        return ok

    none = F.array().cast("array<double>")
    asks, out = queries.select("query_id", "query", none.alias("tx"), none.alias("ty")), None
    for i in range(k):
        best = nearest(pool.select("id", "vec", "x", "y"), asks, 1, keep=far if i else None).withColumn("rank", F.lit(i + 1)).checkpoint()
        out = best if out is None else out.union(best)
        # a query without a row left drops out
        took = best.select("query_id", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
        asks = asks.join(took, "query_id").select("query_id", "query", F.array_append("tx", F.col("_x")).alias("tx"), F.array_append("ty", F.col("_y")).alias("ty"))
    return out.select("query_id", "rank", "id", "x", "y", "sim")


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    side = table.column("side").to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy()
    m = np.stack(table.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True) + V.EPS
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = b if len(b) else a
    s = np.round(m[a] @ m[b].T, 6)
    i, j = np.nonzero((s >= threshold) & (ids[a][:, None] < ids[b][None, :])) if b is a else np.nonzero(s >= threshold)
    left, right = ids[a[i]], ids[b[j]]
    return pa.table({"id_a": np.minimum(left, right), "id_b": np.maximum(left, right), "sim": s[i, j]})


def similar_pairs(pool: DataFrame, threshold: float, block_rows: int = 1024) -> DataFrame:
    """All pairs of cosine >= threshold: blocks of rows meet in tiles, one matrix product a tile, spread over tasks."""
    n = pool.count()
    blocks = max(1, -(-n // block_rows))
    dealt = pool.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = dealt.withColumn("o", other).select("id", "vec", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), (F.col("blk") > F.col("o")).cast("int").alias("side"))

    def tile(table: pa.Table) -> pa.Table:
        return _tile(table, threshold)

    return tiles.groupBy("i", "j").applyInArrow(tile, "id_a long, id_b long, sim double")


def mean_pool(pool: DataFrame, by: str) -> DataFrame:
    """Mean vector a group, as an array in order."""
    long = pool.select(by, F.posexplode("vec").alias("pos", "v")).groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def representatives(pool: DataFrame, centroids: DataFrame, by: str) -> DataFrame:
    """The member nearest to its centroid (squared L2), the first id among equals."""
    d = pool.join(small(centroids), by).withColumn("d", F.round(V.dist2(F.col("vec"), F.col("mean")), 6))
    return d.groupBy(by).agg(F.min(F.struct("d", "id")).alias("m"), F.count(F.lit(1)).alias("members")).select(by, F.col("m.id").alias("id"), F.col("m.d").alias("d"), "members")


def kmeans(pool: DataFrame, k: int, seed: int = 1):
    """Clusters by distributed k-means; (pool with prediction, centroids)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = pool.count()
    data = pool.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    model = KMeans(k=max(2, min(k, n)), seed=seed).fit(data)
    centres = pool.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, mean array<double>")
    return model.transform(data).drop("features"), centres
