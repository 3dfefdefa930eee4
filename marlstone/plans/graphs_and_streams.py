"""Decision graphs, knowledge graphs and event streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import graph as G
from marlstone.operators import plugins as P
from marlstone.operators import resolve as R
from marlstone.plans.base import table
from marlstone.sources.scratch import folder
from marlstone.streaming import events as S

c = F.col
#: A small decision graph: (node, interaction, leaf, options, answer -> next).
NODES = [
    ("start", "single_select", False, ["view", "click", "error"], {"view": "look", "click": "act", "error": "fail"}),
    ("look", "single_select", False, ["view", "click", "purchase"], {"view": "look2", "click": "act", "purchase": "buy"}),
    ("look2", "multi_select", False, [], {"__default__": "act", "signup": "buy"}),
    ("act", "boolean", False, ["purchase", "signup"], {"purchase": "buy", "signup": "start"}),
    ("fail", "free_text", False, [], {"__default__": "report"}),
    ("buy", "free_text", False, [], {"__default__": "nowhere"}),
    ("report", "free_text", True, [], {"again": "start"}),
]


def _graph(spark):
    nodes = spark.createDataFrame([(n, i, leaf, o, n in ("start",)) for n, i, leaf, o, _ in NODES], "id string, interaction string, is_leaf boolean, options array<string>, root boolean")
    edges = spark.createDataFrame([(n, a, d) for n, _, _, _, e in NODES for a, d in e.items()], "src string, answer string, dst string")
    return nodes, edges


def graph_violations(spark, sf):
    return G.violations(*_graph(spark)).select("kind", "node_id", "detail")


def graph_walk(spark, sf):
    e = table(spark, sf, "events")
    names = F.array(*[F.lit(n[0]) for n in NODES])
    a = e.withColumn("node_id", F.get(names, (c("event_id") % len(NODES)).cast("int"))).groupBy(c("user_id").alias("case"), "node_id").agg(F.min_by("event_type", "event_id").alias("answer"))
    return G.walk(a, _graph(spark)[1], "start").select("case", "depth", "node_id", "answer", "status")


def all_paths(spark, sf):
    return G.all_paths(_graph(spark)[1].where("dst <> 'start'"), "start")


def edge_route_default(spark, sf):
    nodes, edges = _graph(spark)
    e = table(spark, sf, "events").withColumn("node_id", F.get(F.array(*[F.lit(n[0]) for n in NODES]), (c("event_id") % len(NODES)).cast("int")))
    a = e.join(F.broadcast(nodes.select(c("id").alias("node_id"), "interaction")), "node_id").select("event_id", "node_id", "interaction", c("event_type").alias("answer"))
    return R.route(a, edges).select("event_id", "next", "invalid")


def chain_violations(spark, sf):
    e = table(spark, sf, "events")
    s = e.select(c("user_id").alias("case"), c("event_id").alias("pos"), F.get(F.array(*[F.lit(n[0]) for n in NODES]), (c("event_id") % len(NODES)).cast("int")).alias("node_id"), c("event_type").alias("answer"))
    return G.chain_violations(s, _graph(spark)[1]).groupBy("node_id", "dst").agg(F.count(F.lit(1)).alias("n"))


def _kg(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    t = li.select(F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("subj"), c("l_returnflag").alias("rel"), F.when(c("l_linenumber") == 5, F.concat(F.lit("p"), c("l_partkey").cast("string"))).otherwise(F.concat(F.lit("s"), c("l_suppkey").cast("string"))).alias("obj"))
    passages = li.select(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("passage"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("phrase")).distinct()
    syn = part.select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("a"), F.concat(F.lit("p"), (c("p_partkey") + 1).cast("string")).alias("b"))
    return G.kg_edges(t, passages, syn)


def kg_edges(spark, sf):
    return _kg(spark, sf).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("pairs"))


def _reset(spark, sf):
    li = table(spark, sf, "lineitem")
    ph = li.select(F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("node"), (c("l_discount") * 10 - 0.3).alias("score"))
    ps = li.groupBy(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("node")).agg((F.avg("l_tax") - 0.03).alias("sim"))
    return G.reset_vector(ph.withColumn("score", F.round("score", 6)), ps.withColumn("sim", F.round("sim", 6)))


def ppr_reset(spark, sf):
    """Shares of a whole table's nodes are small, so they have more digits."""
    return _reset(spark, sf).select("node", F.round("reset", 9).alias("reset"))


def ppr_scores(spark, sf):
    return G.pagerank(_kg(spark, sf), _reset(spark, sf)).select("node", F.round("score", 9).alias("score"))


def graph_dot(spark, sf):
    return G.to_dot(_graph(spark)[1])


def first_option_backend(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("options"))
    return P.FirstOption().answer(o).select("o_orderkey", "raw", "confidence")


def _read(spark, sf):
    return S.read_events(spark, f"{sf}/events.parquet")


def _closed(df, spark, sf, late):
    top = table(spark, sf, "events").agg((F.max(c("ts").cast("timestamp")) - F.expr(f"interval {late}")).alias("top"))
    return df.crossJoin(F.broadcast(top)).where("end <= top").drop("top")


def _out(df):
    return df.withColumns({k: F.date_format(k, "yyyy-MM-dd HH:mm:ss") for k in ("start", "end")})


def event_windows(spark, sf):
    """The stream's closed windows; the oracle is the batch twin up to the watermark."""
    return _out(S.drain(S.windowed(_read(spark, sf)), folder(spark, "stream")))


def event_windows_batch(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return _out(_closed(S.windowed(e), spark, sf, "10 minutes"))


def event_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return S.sessions(e).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("largest"))


def episodic_memory(spark, sf):
    s = _read(spark, sf).select(c("user_id").alias("case"), c("event_id").alias("pos"), c("event_type").alias("node_id"), F.concat(F.lit("a"), (c("event_id") % 3).cast("string")).alias("answer"))
    return S.drain(S.episodic(s), folder(spark, "stream")).select("case", "pos", "context")


def resume_append(spark, sf):
    root = folder(spark, "append")
    for _ in range(2):  # the second run finds nothing new
        S.append_resumable(_read(spark, sf).select("event_id", "event_type"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("event_id long, event_type string").json(f"{root}/out")


_E = "n(i, id, k) AS (VALUES " + ", ".join(f"({i}, '{n[0]}', '{n[1]}')" for i, n in enumerate(NODES)) + "), g(src, answer, dst) AS (VALUES " + ", ".join(f"('{n}', '{a}', '{d}')" for n, _, _, _, e in NODES for a, d in e.items()) + ")"
_L = "l AS (SELECT * FROM lineitem), t AS (SELECT 'p' || l_partkey AS s, l_returnflag AS r, CASE WHEN l_linenumber = 5 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS o FROM l), c AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM l), y AS (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 1) AS b FROM part)"
ORACLES = {
    "graph_violations": f"WITH {_E} SELECT 'dangling_edge' AS kind, src AS node_id, dst AS detail FROM g WHERE dst NOT IN (SELECT id FROM n) UNION ALL SELECT 'leaf_with_edge', src, answer FROM g WHERE src = 'report' UNION ALL SELECT 'option_without_edge', s, o FROM (VALUES ('start', 'view'), ('start', 'click'), ('start', 'error'), ('look', 'view'), ('look', 'click'), ('look', 'purchase'), ('act', 'purchase'), ('act', 'signup')) v(s, o) WHERE NOT EXISTS (SELECT 1 FROM g WHERE src = s AND answer = o)",
    "graph_walk": f"WITH RECURSIVE {_E}, a AS (SELECT user_id AS ca, id AS node, arg_min(event_type, event_id) AS answer FROM events JOIN n ON event_id % 7 = i GROUP BY 1, 2), h AS (SELECT ca, node, a.answer, dst FROM a LEFT JOIN g ON g.src = node AND g.answer = a.answer), w(ca, depth, node, path) AS (SELECT DISTINCT ca, 0, 'start', ['start'] FROM h UNION ALL SELECT w.ca, depth + 1, dst, list_append(path, dst) FROM w JOIN h ON h.ca = w.ca AND h.node = w.node WHERE dst IS NOT NULL AND depth < 63 AND NOT list_contains(path[1:len(path) - 1], w.node)) SELECT w.ca AS \"case\", depth, w.node AS node_id, h.answer, CASE WHEN list_contains(path[1:len(path) - 1], w.node) THEN 'cycle' WHEN dst IS NULL THEN 'end' ELSE 'step' END AS status FROM w LEFT JOIN h ON h.ca = w.ca AND h.node = w.node",
    "all_paths": f"WITH RECURSIVE {_E}, e AS (SELECT DISTINCT src, dst FROM g WHERE dst <> 'start'), p(node, path, depth) AS (SELECT 'start', ['start'], 0 UNION ALL SELECT dst, list_append(path, dst), depth + 1 FROM p JOIN e ON src = node WHERE NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, depth FROM p WHERE node NOT IN (SELECT src FROM e)",
    "edge_route_default": f"WITH {_E} SELECT event_id, CASE k WHEN 'multi_select' THEN coalesce(d.dst, x.dst) WHEN 'free_text' THEN d.dst ELSE x.dst END AS next, k IN ('single_select', 'boolean') AND x.dst IS NULL AS invalid FROM events JOIN n ON event_id % 7 = i LEFT JOIN g x ON x.src = id AND x.answer = event_type LEFT JOIN g d ON d.src = id AND d.answer = '__default__'",
    "chain_violations": f"WITH {_E}, s AS (SELECT user_id, event_id, id, event_type, lead(id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events JOIN n ON event_id % 7 = i) SELECT id AS node_id, nx AS dst, count(*) AS n FROM s WHERE nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE src = id AND dst = nx AND answer IN (event_type, '__default__')) GROUP BY 1, 2",
    "kg_edges": f"WITH {_L}, e AS (SELECT s AS a, o AS b, 'relation' AS type, r AS label FROM t WHERE s <> o UNION ALL SELECT o, s, 'relation', 'inv_' || r FROM t WHERE s <> o UNION ALL SELECT a, b, 'contains', 'contains' FROM c UNION ALL SELECT b, a, 'is_in', 'is_in' FROM c UNION ALL SELECT a, b, 'synonym', 'synonym' FROM y UNION ALL SELECT b, a, 'synonym', 'synonym' FROM y) SELECT type, label, count(*) AS n, count(DISTINCT (a, b)) AS pairs FROM e GROUP BY 1, 2",
    "ppr_reset": "WITH l AS (SELECT * FROM lineitem), b AS (SELECT 'p' || l_partkey AS node, avg(round(l_discount * 10 - 0.3, 6)) AS m FROM l GROUP BY 1 ORDER BY m DESC, node LIMIT 5), v AS (SELECT node, greatest(0.0, m) AS v FROM b UNION ALL SELECT 'o' || l_orderkey, 0.05 * greatest(0.0, round(avg(l_tax) - 0.03, 6)) FROM l GROUP BY l_orderkey) SELECT node, round(sum(v) / sum(sum(v)) OVER (), 9) AS reset FROM v GROUP BY node",
    "first_option_backend": "SELECT o_orderkey, o_orderstatus AS raw, 1.0::DOUBLE AS confidence FROM orders",
    "event_windows_batch": "WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, n, total FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS largest FROM n GROUP BY 1",
    "resume_append": "SELECT event_id, event_type FROM events",
    "episodic_memory": "WITH s AS (SELECT user_id, event_id, event_type || '=a' || (event_id % 3) AS x FROM events) SELECT user_id AS \"case\", event_id AS pos, coalesce(string_agg(x, '; ') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM s",
}
ORACLES["event_windows"] = ORACLES["event_windows_batch"]
QUERIES = {n: globals()[n] for n in [*ORACLES, "ppr_scores", "graph_dot"]}
