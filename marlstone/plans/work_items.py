"""Joins, manifests, windows and set operations over work items."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import context as C
from marlstone.operators import metrics as M
from marlstone.operators import resolve as R
from marlstone.plans.base import table

c = F.col


def _orders(spark, sf):
    return table(spark, sf, "orders")


def pred_gt_inner(spark, sf):
    o = _orders(spark, sf)
    pred = o.where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("slide_id"), c("o_orderstatus").alias("pred"), F.lit("x").alias("split"))
    gt = o.where("o_orderkey % 2 = 0").select(c("o_orderkey").alias("slide_id"), c("o_orderpriority").alias("gt"), F.when(c("o_custkey") % 2 == 0, "test").otherwise("train").alias("split"))
    return R.pred_gt(pred, gt, "test").select("slide_id", "pred", "gt", "split")


def _names(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(c("s_suppkey").alias("ord"), c("s_name").alias("slide_id"), F.concat(F.lit("disk_"), (c("s_suppkey") % 50).cast("string")).alias("disk_name"), F.concat(F.lit("SP-"), c("s_suppkey").cast("string")).alias("specimen"))


def alias_resolve(spark, sf):
    n = _names(spark, sf)
    items = n.select("ord", F.when(c("ord") % 4 == 0, F.concat(F.lit("/x/"), F.upper("slide_id"))).when(c("ord") % 4 == 1, c("disk_name")).when(c("ord") % 4 == 2, c("specimen")).otherwise(F.concat(F.lit("no_"), c("ord").cast("string"))).alias("name"))
    return R.canonical(items, "name", R.alias_table(n, ["slide_id", "disk_name", "specimen"], "ord"), "slide_id").select("ord", "name", "canonical")


def _agreed(spark, sf):
    k = table(spark, sf, "customer")
    parts = [F.concat(F.lit("a/"), c("c_custkey").cast("string")), F.when(c("c_custkey") % 3 == 0, (c("c_custkey") + 1).cast("string")), F.when(c("c_custkey") % 5 == 0, F.lit("nan"))]
    cells = k.select(c("c_custkey").alias("row_id"), F.when(c("c_custkey") % 2 == 0, F.concat_ws(",", *parts)).otherwise(F.concat_ws(" ; ", *parts)).alias("cell"))
    tokens = k.where("c_custkey % 7 <> 0").select(c("c_custkey").cast("string").alias("token"), F.floor(c("c_custkey") / 4).cast("string").alias("case_key"))
    splits = tokens.select("case_key").distinct().where("cast(case_key as bigint) % 6 <> 0").withColumn("split", F.when(c("case_key").cast("long") % 3 == 0, "test").otherwise("train"))
    return R.agree(cells, tokens, splits)


def all_tokens_agree(spark, sf):
    return _agreed(spark, sf)


def restamp_split(spark, sf):
    k = table(spark, sf, "customer").select(c("c_custkey").alias("row_id"), F.when(c("c_custkey") % 2 == 0, "test").otherwise("train").alias("split"))
    return R.restamp(k, _agreed(spark, sf)).groupBy("change", "stamped").agg(F.count(F.lit(1)).alias("n"))


def asof_level(spark, sf):
    p = table(spark, sf, "part")
    levels = p.where("p_size % 3 = 0").select("p_brand", c("p_size").alias("level")).distinct()
    req = p.select("p_brand", c("p_size").alias("req")).distinct()
    return R.asof_level(req, levels, "p_brand")


def missing_artifacts_anti(spark, sf):
    o = _orders(spark, sf).select(c("o_orderkey").alias("k"), "o_orderdate")
    return R.missing(o, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("k")), ["k"]).select("k")


def first_incomplete(spark, sf):
    o = _orders(spark, sf).select(c("o_orderkey").alias("k"))
    return R.first_incomplete(o, table(spark, sf, "lineitem").where("l_linenumber = 3").select(c("l_orderkey").alias("k")), "k", "k")


def prereq_status(spark, sf):
    o = _orders(spark, sf).withColumn("c_custkey", c("o_custkey"))
    return R.readiness(table(spark, sf, "customer").select("c_custkey"), {"order": o, "final": o.where("o_orderstatus = 'F'"), "urgent": o.where("o_orderpriority = '1-URGENT'")}, "c_custkey")


def source_presence_outer(spark, sf):
    li = table(spark, sf, "lineitem")
    return R.presence({"thumb": li.where("l_quantity < 5").select(c("l_partkey").alias("k")), "cache": li.where("l_discount > 0.08").select(c("l_partkey").alias("k")), "run": table(spark, sf, "part").where("p_size > 40").select(c("p_partkey").alias("k"))}, "k")


def resolve_first_path(spark, sf):
    s = _names(spark, sf)
    index = s.where("ord % 3 <> 0").select(c("specimen").alias("name")).union(s.where("ord % 2 = 0").select("slide_id"))
    return R.resolve_path(s, index, [c("slide_id"), c("specimen"), c("disk_name")], "ord")


def case_manifest(spark, sf):
    o = _orders(spark, sf).join(table(spark, sf, "customer").select(c("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    rows = o.select(c("o_custkey").alias("case_id"), c("o_orderkey").alias("slide"), c("o_orderkey").alias("ord"), F.when(c("o_orderkey") % 4 == 0, "").otherwise(F.concat_ws("-", "c_mktsegment", "o_orderstatus")).alias("label"), (c("o_orderkey") % 5 == 0).alias("duplicate"))
    return R.manifest(rows)


def stage_status_counts(spark, sf):
    m = table(spark, sf, "lineitem").where("l_linenumber <= 2 and l_orderkey % 4 <> 1").select(c("l_orderkey").alias("k"), F.when(c("l_linestatus") == "F", "done").otherwise("failed").alias("state"))
    return R.status_counts(_orders(spark, sf).select(c("o_orderkey").alias("k"), "o_orderpriority"), m, "k").groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


def severity_pick(spark, sf):
    names = F.array(*map(F.lit, ("Malignant", "premalignant", "benign ", "reactive", "other")))
    o = _orders(spark, sf).select(c("o_custkey").alias("case_key"), c("o_orderkey").alias("pos"), c("o_orderkey").cast("string").alias("slide_id"), F.get(names, (c("o_orderkey") % 5).cast("int")).alias("diagnosis"), F.when(c("o_custkey") % 3 == 0, F.lit("8")).alias("stored_pick"))
    return R.severity_pick(o)


def resume_skip_done(spark, sf):
    o = _orders(spark, sf)
    done = o.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return R.missing(o.select("o_custkey").distinct(), done, ["o_custkey"])


def set_operations(spark, sf):
    li, o = table(spark, sf, "lineitem").select(c("l_suppkey").alias("k")), table(spark, sf, "orders").select(c("o_custkey").alias("k"))
    out = [("intersect", li.intersect(o)), ("union", li.union(o).distinct()), ("except", o.subtract(li)), ("concat", li.unionByName(o))]
    res = None
    for n, df in out:
        part = df.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).select(F.lit(n).alias("op"), "n", "total")
        res = part if res is None else res.union(part)
    return res


def train_test_size(spark, sf):
    return R.train_test(table(spark, sf, "customer").select("c_custkey"), "c_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _steps(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select(c("conv_id").alias("case"), c("turn").alias("pos"), F.when(c("turn") % 5 == 3, F.lit(None)).otherwise(F.concat_ws("_", "role", c("turn").cast("string"))).alias("node_id"), c("text").alias("question"), F.when(c("turn") % 4 == 2, F.lit("")).otherwise(c("text")).alias("answer"))


def prior_context(spark, sf):
    return C.prior_context(_steps(spark, sf)).select("case", "pos", "context")


def last4_context(spark, sf):
    return C.prior_context(_steps(spark, sf), 4).select("case", "pos", "context")


def next_question_lead(spark, sf):
    return C.next_question(_steps(spark, sf)).select("case", "pos", "next_question")


def latest_anchor(spark, sf):
    e = table(spark, sf, "events")
    s = e.select(c("user_id").alias("case"), c("event_id").alias("pos"), F.when(c("event_type") == "error", "mass_site").otherwise(c("event_type")).alias("node_id"), F.when(c("event_id") % 3 == 0, "unsure").otherwise("seen").alias("answer"), F.concat_ws("x", (c("event_id") % 100).cast("string"), (c("event_id") % 77).cast("string")).alias("coord"))
    return C.latest_anchor(s).select("case", "pos", "anchor")


def retry_best(spark, sf):
    e = table(spark, sf, "events")
    a = e.select(c("user_id").alias("case"), c("event_type").alias("node_id"), (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))).alias("attempt"), F.when(c("event_id") % 4 != 0, F.concat(F.lit("a"), (c("event_id") % 6).cast("string"))).alias("answer"), F.round(c("value") % 1, 4).alias("confidence"))
    return C.retry_best(a)


def strided_pick(spark, sf):
    return C.strided_pick(_orders(spark, sf).select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 20)


def linspace_pick(spark, sf):
    return C.linspace_pick(_orders(spark, sf).select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 7)


def reindex_sorted(spark, sf):
    n = _names(spark, sf).select(F.when(c("ord") % 5 != 0, c("ord") % 40).alias("number"), "slide_id")
    return C.reindex(n, "number", "slide_id")


def inner_loop(spark, sf):
    e = table(spark, sf, "events")
    it = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    s = e.select(c("user_id").alias("case"), c("event_type").alias("node_id"), it.alias("iter"), F.array((c("event_id") % 9).cast("int"), (c("event_id") % 5).cast("int")).alias("patch_ids"), (c("value") > 15).alias("sufficient"))
    return C.inner_loop(s).select("case", "node_id", "iter", "sufficient", F.array_join("excluded", ",").alias("excluded"))


def accuracy_grouping_sets(spark, sf):
    li = table(spark, sf, "lineitem").select(c("l_returnflag").alias("interaction"), c("l_linestatus").alias("node"), (c("l_quantity") > 25).alias("correct"))
    return M.accuracy_cuts(li, "interaction", "node")


def branch_choice(spark, sf):
    o = _orders(spark, sf)
    return o.select("o_orderkey", C.branch_reason((c("o_totalprice") < 50000, "cheap"), (c("o_orderstatus") == "F", "final"), (c("o_custkey") % 2 == 0, "even")).alias("reason"))


_AGREE = """k AS (SELECT c_custkey FROM customer), t AS (SELECT c_custkey::VARCHAR AS token, (c_custkey // 4)::VARCHAR AS case_key FROM k WHERE c_custkey % 7 <> 0),
 s AS (SELECT DISTINCT case_key, CASE WHEN case_key::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM t WHERE case_key::BIGINT % 6 <> 0),
 x AS (SELECT c_custkey AS row_id, c_custkey::VARCHAR AS token FROM k UNION ALL SELECT c_custkey, (c_custkey + 1)::VARCHAR FROM k WHERE c_custkey % 3 = 0),
 a AS (SELECT row_id, CASE WHEN count(*) = count(case_key) AND count(DISTINCT case_key) = 1 THEN min(case_key) END AS case_key FROM x LEFT JOIN t USING (token) GROUP BY row_id),
 m AS (SELECT row_id, a.case_key, split, split IS NOT NULL AS mapped FROM a LEFT JOIN s ON a.case_key = s.case_key)"""
_STEP = "s AS (SELECT conv_id AS \"case\", turn AS pos, CASE WHEN turn % 5 = 3 THEN NULL ELSE role || '_' || turn END AS node_id, text AS question, CASE WHEN turn % 4 = 2 THEN '' ELSE text END AS answer FROM conversations), f AS (SELECT *, CASE WHEN coalesce(node_id, '') <> '' AND coalesce(answer, '') <> '' THEN node_id || '=' || answer END AS said FROM s)"
_NAMED = "n AS (SELECT s_suppkey AS ord, s_name AS slide_id, 'disk_' || (s_suppkey % 50) AS disk_name, 'SP-' || s_suppkey AS specimen FROM supplier)"
_EV = "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)"
ORACLES = {
    "pred_gt_inner": "SELECT p.o_orderkey AS slide_id, p.o_orderstatus AS pred, g.o_orderpriority AS gt, 'test' AS split FROM orders p JOIN orders g ON p.o_orderkey = g.o_orderkey WHERE p.o_orderkey % 3 <> 0 AND g.o_orderkey % 2 = 0 AND g.o_custkey % 2 = 0",
    "alias_resolve": f"WITH {_NAMED}, i AS (SELECT ord, CASE ord % 4 WHEN 0 THEN '/x/' || upper(slide_id) WHEN 1 THEN disk_name WHEN 2 THEN specimen ELSE 'no_' || ord END AS name FROM n), a AS (SELECT lower(slide_id) AS alias, 0 AS p, ord, slide_id FROM n UNION ALL SELECT lower(disk_name), 1, ord, slide_id FROM n UNION ALL SELECT lower(specimen), 2, ord, slide_id FROM n), b AS (SELECT alias, slide_id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY p, ord DESC) AS r FROM a) WHERE r = 1) SELECT ord, name, coalesce(b.slide_id, string_split(name, '/')[-1]) AS canonical FROM i LEFT JOIN b ON b.alias = lower(string_split(name, '/')[-1])",
    "all_tokens_agree": f"WITH {_AGREE} SELECT row_id, case_key, split, mapped FROM m",
    "restamp_split": f"WITH {_AGREE}, o AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 2 = 0 THEN 'test' ELSE 'train' END AS old FROM k) SELECT CASE WHEN split IS NULL THEN 'unmapped' WHEN split = old THEN 'unchanged' ELSE 'flipped' END AS change, coalesce(split, old) AS stamped, count(*) AS n FROM o LEFT JOIN m USING (row_id) GROUP BY ALL",
    "asof_level": "WITH l AS (SELECT DISTINCT p_brand, p_size AS level FROM part WHERE p_size % 3 = 0), r AS (SELECT DISTINCT p_brand, p_size AS req FROM part) SELECT p_brand, req, coalesce(max(level) FILTER (level <= req), max(level)) AS level FROM r JOIN l USING (p_brand) GROUP BY p_brand, req",
    "missing_artifacts_anti": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "first_incomplete": "SELECT coalesce(min(o_orderkey) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)), count(*)) AS first_incomplete FROM orders",
    "prereq_status": "WITH f AS (SELECT c_custkey, count(o_orderkey) > 0 AS a, coalesce(bool_or(o_orderstatus = 'F'), false) AS b, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT c_custkey, a AS has_order, b AS has_final, d AS has_urgent, a AND b AND d AS ready, concat_ws(',', CASE WHEN NOT a THEN 'order' END, CASE WHEN NOT b THEN 'final' END, CASE WHEN NOT d THEN 'urgent' END) AS missing FROM f",
    "source_presence_outer": "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 5), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08), d AS (SELECT p_partkey AS k FROM part WHERE p_size > 40) SELECT coalesce(a.k, b.k, d.k) AS k, a.k IS NOT NULL AS in_thumb, b.k IS NOT NULL AS in_cache, d.k IS NOT NULL AS in_run FROM a FULL JOIN b ON a.k = b.k FULL JOIN d ON coalesce(a.k, b.k) = d.k",
    "resolve_first_path": f"WITH {_NAMED}, i AS (SELECT specimen AS name FROM n WHERE ord % 3 <> 0 UNION SELECT slide_id FROM n WHERE ord % 2 = 0) SELECT ord, CASE WHEN slide_id IN (SELECT name FROM i) THEN slide_id WHEN specimen IN (SELECT name FROM i) THEN specimen END AS path FROM n",
    "case_manifest": "SELECT o_custkey AS case_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS slide_ids, arg_max(c_mktsegment || '-' || o_orderstatus, o_orderkey) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0) AS label, count(*) AS n_slides, min(o_orderkey) AS first_ord FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey",
    "stage_status_counts": "WITH m AS (SELECT l_orderkey AS k, bool_or(l_linestatus = 'F') AS d FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 4 <> 1 GROUP BY 1) SELECT o_orderpriority, CASE WHEN d THEN 'done' WHEN d IS NOT NULL THEN 'failed' ELSE 'missing' END AS status, count(*) AS n FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY ALL",
    "severity_pick": "WITH r AS (SELECT o_custkey AS case_key, o_orderkey, [5, 4, 3, 2, 0][o_orderkey % 5 + 1] AS rank FROM orders) SELECT case_key, coalesce(max(CASE WHEN case_key % 3 = 0 AND o_orderkey = 8 THEN '8' END), arg_max(o_orderkey::VARCHAR, rank::BIGINT * 1000000000 - o_orderkey)) AS chosen, max(rank) AS rank, CASE WHEN max(CASE WHEN case_key % 3 = 0 AND o_orderkey = 8 THEN '8' END) IS NOT NULL THEN 'stored' ELSE 'severity_fallback' END AS method FROM r GROUP BY case_key",
    "resume_skip_done": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "set_operations": "WITH l AS (SELECT l_suppkey AS k FROM lineitem), o AS (SELECT o_custkey AS k FROM orders) SELECT 'intersect' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT k FROM l INTERSECT SELECT k FROM o) UNION ALL SELECT 'union', count(*), sum(k)::BIGINT FROM (SELECT k FROM l UNION SELECT k FROM o) UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM (SELECT k FROM o EXCEPT SELECT k FROM l) UNION ALL SELECT 'concat', count(*), sum(k)::BIGINT FROM (SELECT k FROM l UNION ALL SELECT k FROM o)",
    "train_test_size": "WITH n AS (SELECT count(*) AS n FROM customer) SELECT 'test' AS split, least(70, greatest(1, n // 3)) AS n FROM n UNION ALL SELECT 'train', n - least(70, greatest(1, n // 3)) FROM n",
    "prior_context": f"WITH {_STEP} SELECT a.\"case\", a.pos, coalesce((SELECT string_agg(b.said, '; ' ORDER BY b.pos) FROM f b WHERE b.\"case\" = a.\"case\" AND b.pos < a.pos), '') AS context FROM f a",
    "last4_context": f"WITH {_STEP} SELECT a.\"case\", a.pos, coalesce((SELECT string_agg(b.said, '; ' ORDER BY b.pos) FROM f b WHERE b.\"case\" = a.\"case\" AND b.pos < a.pos AND b.pos >= a.pos - 4), '') AS context FROM f a",
    "next_question_lead": f"WITH {_STEP} SELECT \"case\", pos, lead(question, 1, '') OVER (PARTITION BY \"case\" ORDER BY pos) AS next_question FROM s",
    "latest_anchor": "SELECT user_id AS \"case\", event_id AS pos, last_value(CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN (event_id % 100) || 'x' || (event_id % 77) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM events",
    "retry_best": f"WITH a AS (SELECT user_id AS \"case\", event_type AS node_id, {_EV} AS attempt, CASE WHEN event_id % 4 <> 0 THEN 'a' || (event_id % 6) END AS answer, round(value % 1, 4) AS confidence FROM events), b AS (SELECT *, min(CASE WHEN answer IS NOT NULL AND confidence >= 0.65 THEN attempt END) OVER (PARTITION BY \"case\", node_id) AS stop FROM a WHERE attempt <= 2), d AS (SELECT *, row_number() OVER (PARTITION BY \"case\", node_id ORDER BY confidence DESC, attempt) AS r FROM b WHERE (stop IS NULL OR attempt <= stop) AND answer IS NOT NULL) SELECT \"case\", node_id, answer, confidence FROM d WHERE r = 1",
    "strided_pick": "SELECT o_orderpriority, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % greatest(n // 20, 1) = 0 AND r // greatest(n // 20, 1) < 20",
    "linspace_pick": "SELECT o_orderpriority, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r IN (SELECT i * (n - 1) // 6 FROM (SELECT unnest(range(7)) AS i))",
    "reindex_sorted": "SELECT CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 40 END AS number, s_name AS slide_id, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 40 END, 1000000000), s_name) - 1 AS INT) AS idx FROM supplier",
    "inner_loop": f"WITH s AS (SELECT user_id AS \"case\", event_type AS node_id, {_EV} - 1 AS iter, event_id % 9 AS p, event_id % 5 AS q, value > 15 AS sufficient FROM events), t AS (SELECT *, min(CASE WHEN sufficient THEN iter END) OVER (PARTITION BY \"case\", node_id) AS stop FROM s), r AS (SELECT * FROM t WHERE iter < 3 AND (stop IS NULL OR iter <= stop)), u AS (SELECT \"case\", node_id, iter, p AS x FROM r UNION ALL SELECT \"case\", node_id, iter, q FROM r) SELECT r.\"case\", r.node_id, CAST(r.iter AS INT) AS iter, sufficient, coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT DISTINCT x FROM u WHERE u.\"case\" = r.\"case\" AND u.node_id = r.node_id AND u.iter < r.iter)), '') AS excluded FROM r",
    "accuracy_grouping_sets": "SELECT l_returnflag AS interaction, l_linestatus AS node, count(*) FILTER (l_quantity > 25) AS n_correct, count(*) AS n, round(avg((l_quantity > 25)::INT), 6) AS accuracy FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))",
    "branch_choice": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'F' THEN 'final' END, CASE WHEN o_custkey % 2 = 0 THEN 'even' END) AS reason FROM orders",
}
QUERIES = {n: globals()[n] for n in ORACLES}
