"""Decision graphs (nodes, edges), walks over all cases at once, and the knowledge graph with personalized PageRank."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.scratch import folder, shared

MAX_STEPS = 64


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, node_id, detail): edges to nowhere, leaves with edges, select options without an edge, roots other than one."""
    dangling = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.lit("dangling_edge").alias("kind"), F.col("src").alias("node_id"), F.col("dst").alias("detail"))
    leaf = edges.join(nodes.where("is_leaf").select(F.col("id").alias("src")), "src", "left_semi").select(F.lit("leaf_with_edge"), F.col("src"), F.col("answer"))
    answers = edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("answer").alias("answers"))
    opts = nodes.where(F.col("interaction").isin("single_select", "boolean")).join(answers, "id", "left")
    bare = opts.select(F.lit("option_without_edge"), "id", F.explode(F.array_except("options", F.coalesce("answers", F.array().cast("array<string>")))))
    roots = nodes.agg(F.count_if("root").alias("n")).where("n <> 1").select(F.lit("roots"), F.lit(""), F.col("n").cast("string"))
    return dangling.union(leaf).union(bare).union(roots)


def chain_violations(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps whose successor is not reached by an edge of their answer."""
    from pyspark.sql import Window

    nxt = F.lead("node_id").over(Window.partitionBy("case").orderBy("pos"))
    s = steps.withColumn("dst", nxt).where("dst is not null")
    e = edges.select(F.col("src").alias("node_id"), "answer", "dst")
    any_default = edges.where("answer = '__default__'").select(F.col("src").alias("node_id"), "dst")
    return s.join(e, ["node_id", "answer", "dst"], "left_anti").join(any_default, ["node_id", "dst"], "left_anti").select("case", "pos", "node_id", "answer", "dst")


def walk(answers: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """All cases walk from the root by their answers (case, node_id, answer): case, depth, node_id, answer, status
    (step, end, cycle). One recursive query; 64 steps at most."""
    spark = answers.sparkSession
    a, e = f"_answers_{uuid.uuid4().hex}", f"_edges_{uuid.uuid4().hex}"
    hop = answers.alias("a").join(edges.alias("e"), (F.col("a.node_id") == F.col("e.src")) & (F.col("a.answer") == F.col("e.answer")), "left").select("a.case", "a.node_id", "a.answer", F.col("e.dst").alias("dst"))
    hop.createOrReplaceTempView(a)
    edges.createOrReplaceTempView(e)
    return spark.sql(f"""
        WITH RECURSIVE w(case, depth, node_id, path) AS (
          SELECT DISTINCT case, 0, '{root}', array('{root}') FROM {a}
          UNION ALL
          SELECT w.case, w.depth + 1, h.dst, array_append(w.path, h.dst) FROM w JOIN {a} h ON h.case = w.case AND h.node_id = w.node_id
          WHERE h.dst IS NOT NULL AND w.depth < {MAX_STEPS - 1} AND NOT (array_contains(slice(w.path, 1, size(w.path) - 1), w.node_id)))
        SELECT w.case, w.depth, w.node_id, h.answer,
          CASE WHEN array_contains(slice(w.path, 1, size(w.path) - 1), w.node_id) THEN 'cycle' WHEN h.dst IS NULL THEN 'end' ELSE 'step' END AS status
        FROM w LEFT JOIN {a} h ON h.case = w.case AND h.node_id = w.node_id""")


def all_paths(edges: DataFrame, root: str) -> DataFrame:
    """Every path from the root to a node without edges, as ``a>b>c``."""
    spark = edges.sparkSession
    e = f"_edges_{uuid.uuid4().hex}"
    edges.select("src", "dst").distinct().createOrReplaceTempView(e)
    return spark.sql(f"""
        WITH RECURSIVE p(node, path, depth) AS (SELECT '{root}', array('{root}'), 0 UNION ALL
          SELECT e.dst, array_append(p.path, e.dst), p.depth + 1 FROM p JOIN {e} e ON e.src = p.node WHERE NOT array_contains(p.path, e.dst) AND p.depth < {MAX_STEPS})
        SELECT array_join(path, '>') AS path, depth FROM p LEFT ANTI JOIN {e} e ON e.src = p.node""")


def kg_edges(triples: DataFrame, passages: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Directed typed multigraph (src, dst, type, label) of triples (subj, rel, obj), passages (passage, phrase), and
    synonym pairs in both directions: relation and inverse edges without self loops, contains and is_in."""
    edge = lambda df, s, d, t, label: df.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(t).alias("type"), label.alias("label"))
    proper = triples.where("subj <> obj")
    out = edge(proper, "subj", "obj", "relation", F.col("rel")).union(edge(proper, "obj", "subj", "relation", F.concat(F.lit("inv_"), F.col("rel"))))
    out = out.union(edge(passages, "passage", "phrase", "contains", F.lit("contains"))).union(edge(passages, "phrase", "passage", "is_in", F.lit("is_in")))
    if synonyms is not None:
        out = out.union(edge(synonyms, "a", "b", "synonym", F.lit("synonym"))).union(edge(synonyms, "b", "a", "synonym", F.lit("synonym")))
    return out


def reset_vector(phrases: DataFrame, passages: DataFrame, top: int = 5, weight: float = 0.05) -> DataFrame:
    """(node, reset): the top phrases' positive mean scores and a small positive part of every passage's similarity,
    normalized; uniform if all is 0."""
    best = phrases.groupBy("node").agg(F.avg("score").alias("m")).orderBy(F.col("m").desc(), "node").limit(top)
    both = best.select("node", F.greatest(F.lit(0.0), F.col("m")).alias("v")).union(passages.select("node", (weight * F.greatest(F.lit(0.0), F.col("sim"))).alias("v")))
    by = both.groupBy("node").agg(F.sum("v").alias("v"))
    every = by.agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(every)).select("node", F.when(F.col("total") > 0, F.col("v") / F.col("total")).otherwise(1.0 / F.col("n")).alias("reset"))


def _ppr_numpy(src, dst, reset, damping, rounds):
    n = len(reset)
    degree = np.bincount(src, minlength=n)
    p = reset.copy()
    for _ in range(rounds):
        flow = np.bincount(dst, p[src] / degree[src], n)
        p = (1 - damping) * reset + damping * (flow + p[degree == 0].sum() * reset)
    return p


SMALL_EDGES = 100_000
#: Nodes whose scores, 8 bytes each, are one vector on the driver and in each task. Beyond: joins.
VECTOR_NODES = 16_000_000
#: Edges of a block of neighbouring numbers, about, and those whose numbers a task holds before it deals them to blocks.
BLOCK_EDGES, HELD_EDGES = 2_000_000, 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files in the shared folder; shuffles that made it go at once."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def _dealt(numbers, width: int):
    """Edges of hashes to chunks of numbers by block of their end."""

    def chunks(src, dst):
        src, dst = np.searchsorted(numbers.value, np.concatenate(src)).astype("<i4"), np.searchsorted(numbers.value, np.concatenate(dst)).astype("<i4")
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        blocks, at = np.unique(dst // width, return_index=True)
        ends = [*at[1:], len(dst)]
        return pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "src": pa.array([src[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()), "dst": pa.array([dst[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})

    def run(batches):
        src, dst, held = [], [], 0
        for b in batches:
            src.append(b["s"].to_numpy())
            dst.append(b["d"].to_numpy())
            held += b.num_rows
            if held >= HELD_EDGES:
                yield chunks(src, dst)
                src, dst, held = [], [], 0
        if held:
            yield chunks(src, dst)

    return run


def _block(table: pa.Table) -> pa.Table:
    """A block's edges in order of their ends, in pieces: the ends' numbers, their edges' starts, the edges' sources."""
    src, dst = (np.concatenate([np.frombuffer(x, "<i4") for x in table[k].to_pylist()]) for k in ("src", "dst"))
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    rows = {"ends": [], "starts": [], "src": []}
    for i in range(0, len(dst), HELD_EDGES):
        ends, starts = np.unique(dst[i : i + HELD_EDGES], return_index=True)
        for k, x in zip(rows, (ends, starts.astype("<i4"), src[i : i + HELD_EDGES])):
            rows[k].append(x.tobytes())
    return pa.table({k: pa.array(v, pa.binary()) for k, v in rows.items()})


def _flows(given):
    def run(batches):
        for b in batches:
            for ends, starts, src in zip(*(b[k] for k in ("ends", "starts", "src"))):
                at, of = np.frombuffer(starts.as_buffer(), "<i4"), np.frombuffer(src.as_buffer(), "<i4")
                yield pa.RecordBatch.from_pydict({"ends": pa.array([ends.as_py()], pa.binary()), "flow": pa.array([np.add.reduceat(given.value[of], at).tobytes()], pa.binary())})

    return run


def _ppr_vector(edges: DataFrame, nodes: DataFrame, damping: float, rounds: int) -> DataFrame:
    """Nodes (node, degree, reset) are numbered in order of a hash that tells all of them apart. Edges are written once,
    as numbers by blocks of their ends; a round sums over them with the scores as one vector, without a shuffle."""
    spark: SparkSession = edges.sparkSession
    for salt in range(64):
        hashed = lambda c: F.xxhash64(F.lit(salt), F.col(c).cast("string"))  # noqa: B023, E731
        t = nodes.select(hashed("node").alias("h"), F.col("degree").cast("int"), "reset").toArrow()
        h = t["h"].to_numpy()
        order = np.argsort(h)
        h = h[order]
        if len(h) < 2 or (h[1:] != h[:-1]).all():
            break
    else:
        raise ValueError("nodes are not distinct")
    degree, r = t["degree"].to_numpy()[order], t["reset"].to_numpy()[order]
    del t, order
    numbers = spark.sparkContext.broadcast(h)
    n, blocks = len(h), int(degree.sum(dtype="i8") // BLOCK_EDGES) + 1
    del h
    dealt = edges.select(hashed("src").alias("s"), hashed("dst").alias("d")).mapInArrow(_dealt(numbers, -(-n // blocks)), "block int, src binary, dst binary")
    e = _write(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_block, "ends binary, starts binary, src binary"), "ppr-edges")
    dead, p = degree == 0, r.copy()
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(p / np.maximum(degree, 1))
        flow = np.zeros(n)
        for row in e.mapInArrow(_flows(given), "ends binary, flow binary").toArrow().to_batches():
            for ends, x in zip(row["ends"], row["flow"]):
                flow[np.frombuffer(ends.as_buffer(), "<i4")] += np.frombuffer(x.as_buffer())
        p = (1 - damping) * r + damping * (flow + p[dead].sum() * r)
        given.destroy()
    scores = spark.sparkContext.broadcast(p)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"node": b["node"], "score": pa.array(scores.value[np.searchsorted(numbers.value, b["h"].to_numpy())])})

    return nodes.select(F.col("node").cast("string").alias("node"), hashed("node").alias("h")).mapInArrow(run, "node string, score double")


def pagerank(edges: DataFrame, reset: DataFrame, damping: float = 0.5, rounds: int = 20, small_edges: int = SMALL_EDGES, vector_nodes: int = VECTOR_NODES) -> DataFrame:
    """(node, score): multi-edges count, a dead end's mass goes to the reset vector. Up to ``small_edges`` edges one
    Arrow task does it; up to ``vector_nodes`` nodes tasks sum over blocks of edges with the scores as one vector;
    beyond that, joins and sums whose lineage is cut in the shared folder."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).union(reset.select("node")).distinct()
    r = nodes.join(reset, "node", "left").fillna({"reset": 0.0})
    if edges.limit(small_edges + 1).count() <= small_edges:
        both = edges.select(F.lit(0).alias("k"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.lit(0.0).alias("v")).union(r.select(F.lit(1), F.col("node").cast("string"), F.lit(None).cast("string"), "reset"))

        def run(table: pa.Table) -> pa.Table:
            t = table.to_pandas()
            v = t[t.k == 1].sort_values("a")
            number = {x: i for i, x in enumerate(v.a)}
            e = t[t.k == 0]
            p = _ppr_numpy(e.a.map(number).to_numpy(), e.b.map(number).to_numpy(), v.v.to_numpy(), damping, rounds)
            return pa.table({"node": pa.array(v.a), "score": pa.array(p)})

        return both.withColumn("g", F.lit(1)).groupBy("g").applyInArrow(run, "node string, score double")
    spark: SparkSession = edges.sparkSession
    shared(spark)
    # read in every round
    no = lambda df, c: df.select(F.col(c).alias("node"), F.lit(0).alias("d"), F.lit(0.0).alias("reset"))
    every = no(edges, "src").withColumn("d", F.lit(1)).union(no(edges, "dst")).union(reset.select("node", F.lit(0), F.coalesce(F.col("reset").cast("double"), F.lit(0.0))))
    counted = _write(every.groupBy("node").agg(F.sum("d").alias("degree"), F.sum("reset").alias("reset")), "ppr-nodes")
    if counted.count() <= vector_nodes:
        return _ppr_vector(edges, counted, damping, rounds)
    r = counted.select("node", "reset")
    both = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    e = both.select("src", "dst", (F.col("m") / F.sum("m").over(_by("src"))).alias("w")).checkpoint()
    dead = r.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node").checkpoint()
    p = r.select("node", F.col("reset").alias("score"))
    for i in range(rounds):
        flow = p.join(e, p["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("w")).alias("f"))
        lost = p.join(dead, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        p = r.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) * F.col("reset") + damping * (F.coalesce("f", F.lit(0.0)) + F.col("lost") * F.col("reset"))).alias("score"))
        if i % 4 == 3:
            p = p.checkpoint()
    return p.select(F.col("node").cast("string").alias("node"), "score")


def _by(c: str):
    from pyspark.sql import Window

    return Window.partitionBy(c)


def to_dot(edges: DataFrame) -> DataFrame:
    """One row: the edges as a DOT digraph, in order."""
    line = F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", F.replace(F.col("answer"), F.lit('"'), F.lit('\\"')))
    return edges.agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n}")).alias("dot"))
