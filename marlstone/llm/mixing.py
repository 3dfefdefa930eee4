"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

Sources are ordered by code point (null last) and weigh ``weights`` in turn. Targets share all words by weight; a target
stops at ``cap`` times its source and the excess is shared again (water filling, solved by two window sums over the
sources). A source's rows are dealt by hash into blocks (about ``BLOCK_DOCS`` rows, at most ``MAX_BLOCKS`` blocks a
source). Its draws are whole passes over its permuted blocks, then a part of a pass up to the target; in the one block
that the target cuts, rows are taken in hash order while they fit, and again among those that still fit, ``FILLS``
times. A binary tree splits the exact block quotas of all sources among the output shards: the slots of a node get
hashed uniforms and the lower half goes left, so the counts of the sources are multivariate hypergeometric and reruns
agree; each shard then takes its own run of a source's permuted draws. Each copy has its shard and a hashed position
there: (shard, position) is the order of the output, and no task has to hold a shard for it.

Bounds: the tree has at most ``MAX_BLOCKS`` x ``cap`` slots a source, whatever the input; tables a source or a
(source, block) row are joined by broadcast only after their rows were counted; no step keeps a source's rows in one
task but those of the block that is cut (1 / blocks of the source), in a window that spills.

Defined results: null text counts 0 words; null is a source of its own; identical rows (id, source, text) are numbered
and each is decided by itself; an empty table gives an empty result; a source without words has target 0; input columns
with the names added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WORD, stage

BLOCK_DOCS, MAX_BLOCKS, FILLS = 2048, 4096, 6
BROADCAST_ROWS = 200_000
OWN = ("_mix_key", "_row", "_rid", "_salt", "_place")
ADDED = ("size", "source_size", "target", "taken", "copies", "shards", "positions")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only what was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def targets(units: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row a source: its size, rows and target. ``units`` has source, size and n (equal rows)."""
    by = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("units"))
    ranked = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights)))
    top = cap * F.col("source_size").cast("double")
    ranked = ranked.withColumns({"top": top, "ratio": top / F.col("weight"), "total": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    order = Window.orderBy("ratio", "sid")
    full = ranked.withColumns({"before": F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    full = full.withColumn("full", F.col("top") * F.col("left") <= (F.col("total") - F.col("before")) * F.col("weight"))
    every = Window.partitionBy()
    spent, open_ = F.sum(F.when(F.col("full"), F.col("top")).otherwise(0.0)).over(every), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return full.withColumn("target", F.when(F.col("full"), F.col("top")).otherwise((F.col("total") - spent) * F.col("weight") / open_)).select("source", "sid", "source_size", "units", "target")


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, sid, quota) from (sid, n): ``levels`` halvings, each a multivariate-hypergeometric draw."""
    slot = quotas.where("n > 0").select("sid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("slot"), F.lit(0).alias("node"))
    for level in range(levels):
        own = Window.partitionBy("node")
        at = F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "node", "sid", "slot"), "sid", "slot"))
        slot = slot.withColumns({"at": at, "all": F.count(F.lit(1)).over(own)})
        slot = slot.select("sid", "slot", (2 * F.col("node") + F.when(2 * F.col("at") > F.col("all"), 1).otherwise(0)).alias("node"))
    return slot.groupBy(F.col("node").alias("shard"), "sid").agg(F.count(F.lit(1)).alias("quota"))


def _fill(cut: DataFrame, seed: int) -> DataFrame:
    """(_mix_key, doc_id, row) of the rows of cut blocks that are taken: ``cut`` has sid, block, room and the rows."""
    own = Window.partitionBy("sid")
    run = own.orderBy("h", "_mix_key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select("sid", "_mix_key", "doc_id", "row", "size", F.col("room").alias("left"), F.xxhash64(F.lit(seed), F.lit(-2), "_mix_key", "doc_id", "row").alias("h"), F.lit(False).alias("in"))
    for _ in range(FILLS):
        fits = ~F.col("in") & (F.col("size") <= F.col("left"))
        cut = cut.withColumn("upto", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(run))
        cut = cut.withColumn("now", fits & (F.col("upto") <= F.col("left")))
        cut = cut.withColumn("left", F.col("left") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(own))
        cut = cut.withColumn("in", F.col("in") | F.col("now"))
    return cut.where("in").select("_mix_key", "doc_id", "row", F.lit(True).alias("_in"))


def _numbered(docs: DataFrame, many: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand in ``many`` (doc_id, _mix_key), numbered among their equals: counted a part of
    the input first, so that a group of any size is never sorted in one task."""
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d._mix_key") == F.col("m._mix_key"))
    rows = docs.alias("d").join(_small(many).alias("m"), same, "left_semi").withColumn("_rid", F.monotonically_increasing_id())
    rows = rows.withColumn("_salt", F.shiftright("_rid", 10))
    parts = rows.groupBy("doc_id", "_mix_key", "_salt").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("doc_id", "_mix_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("doc_id", "_mix_key", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("doc_id", "_mix_key", "_salt").orderBy("_rid"))
    r, p = rows.withColumn("_place", place).alias("r"), parts.alias("p")
    on = F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r._mix_key") == F.col("p._mix_key")) & (F.col("r._salt") == F.col("p._salt"))
    return r.join(p, on).select("r.*", (F.col("p._before") + F.col("r._place")).cast("long").alias("_row")).drop("_rid", "_salt", "_place")


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, levels: int = 4, seed: int = 17, carry: bool = True) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, taken (words, repeats counted), copies and the shards of
    the copies, with each copy's position in its shard. Needs doc_id and source; without ``carry`` only those columns are returned and no text is shuffled."""
    kept = [c for c in docs.columns if c not in (*ADDED, *OWN)]
    key = F.xxhash64("doc_id", "source", text)
    docs = docs.select(*kept, F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("_mix_key"))
    # all decisions are made on a slim table, so that texts are read once more at most
    units = stage(docs.groupBy("doc_id", "source", "_mix_key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    goal = stage(targets(units, weights, cap).withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("units") / BLOCK_DOCS))).cast("int")), "mix-targets")
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.join(_small(goal), rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_mix_key", "row"), F.col("blocks")).cast("int"))

    per = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    per = per.withColumns({"passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"), "perm": F.xxhash64(F.lit(seed), F.lit(-1), "sid", "block")})
    per = per.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    order = Window.partitionBy("sid").orderBy("perm", "block")
    per = per.withColumns({"upto": F.sum("words").over(order), "rank": F.row_number().over(order) - 1, "n_blocks": F.count(F.lit(1)).over(Window.partitionBy("sid"))})
    per = per.withColumn("extra", F.when(F.col("upto") <= F.col("rest"), "whole").when(F.col("upto") - F.col("words") < F.col("rest"), "cut").otherwise("none"))
    per = stage(per.withColumn("room", F.col("rest") - F.col("upto") + F.col("words")).drop("perm"), "mix-blocks")

    drawn = per.groupBy("sid").agg((F.max(F.col("passes").cast("long") * F.col("n_blocks")) + F.count_if(F.col("extra") != "none")).alias("n"))
    quotas = split_tree(drawn, levels, seed)
    upto = quotas.withColumn("upto", F.sum("quota").over(Window.partitionBy("sid").orderBy("shard")))
    upto = upto.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    # every draw of a block has a place in its source's permuted sequence, a pass after the other
    draw = per.select("sid", "block", "n_blocks", "rank", "passes", "extra", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass")).where((F.col("pass") < F.col("passes")) | (F.col("extra") != "none"))
    shuffled = Window.partitionBy("sid", "pass").orderBy(F.when(F.col("pass") < F.col("passes"), F.xxhash64(F.lit(seed), "pass", "block")).otherwise(F.col("rank")), "block")
    draw = draw.withColumn("place", F.col("pass").cast("long") * F.col("n_blocks") + F.row_number().over(shuffled) - 1)
    draw = draw.join(_small(upto), "sid").withColumn("shard", F.get(F.filter("ends", lambda e: e["upto"] > F.col("place")), 0)["shard"])
    by_block = draw.groupBy("sid", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("pass") < F.col("passes"), F.col("shard")).when(F.col("extra") == "whole", F.col("shard")))).alias("whole"),
        F.max(F.when((F.col("pass") == F.col("passes")) & (F.col("extra") == "cut"), F.col("shard"))).alias("cut_shard"),
    )

    # rows of a block that the target cuts: in hash order, as long as they fit
    picks = _fill(rows.join(_small(per.where("extra = 'cut'").select("sid", "block", "room")), ["sid", "block"]), seed)
    pick = _small(stage(picks, "mix-picks"))
    rows = rows.join(_small(stage(by_block, "mix-draws")), ["sid", "block"], "left")
    same = rows["doc_id"].eqNullSafe(pick["doc_id"]) & (rows["_mix_key"] == pick["_mix_key"]) & (rows["row"] == pick["row"])
    rows = rows.join(pick, same, "left").drop(pick["doc_id"]).drop(pick["_mix_key"]).drop(pick["row"])
    shards = F.concat(F.coalesce("whole", F.array().cast("array<int>")), F.when(F.col("_in"), F.array("cut_shard")).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("shards", shards).withColumn("copies", F.size("shards"))
    place = lambda s, i: F.xxhash64(F.lit(seed), F.lit(-3), s, i, F.col("doc_id"), F.col("_mix_key"), F.col("row"))
    rows = rows.withColumn("positions", F.transform("shards", place))
    decided = rows.select("doc_id", "_mix_key", "source", "size", "n", F.col("row").alias("_row"), "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards", "positions")
    if not carry:
        return decided.select("doc_id", "source", *ADDED)
    d, u = docs.alias("d"), decided.drop("source", "size").alias("u")
    same = F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("d._mix_key") == F.col("u._mix_key"))
    columns = [*[F.col(f"d.{c}") for c in kept], F.col("d.size"), *[F.col(f"u.{c}") for c in ADDED[1:]]]
    many = units.where("n > 1").select("doc_id", "_mix_key")
    if many.isEmpty():
        return d.join(u, same).select(*columns)
    one = d.join(decided.where("n = 1").drop("source", "size").alias("u"), same).select(*columns)
    numbered = _numbered(docs, many).alias("d")
    return one.union(numbered.join(decided.where("n > 1").drop("source", "size").alias("u"), same & (F.col("d._row") == F.col("u._row"))).select(*columns))
