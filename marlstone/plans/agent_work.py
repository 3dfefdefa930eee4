"""What nodes ask for, the walk with all its endings, records of it, and the knowledge graph's ways."""

from pyspark.sql import functions as F

from marlstone.operators import evidence as V
from marlstone.operators import extraction as X
from marlstone.operators import knowledge as K
from marlstone.plans.base import table
from marlstone.plans.graphs_and_streams import _E, NODES, _graph

c = F.col


def _of(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


POLICIES, TIERS, KINDS, ZOOMS = ("patch_retrieve", "both", "none", "thumbnail"), ("Integration", "core", None), ("report", "Integration", "leaf", None, "x"), ("40x", "20x", "10x", "5x")


def node_policies(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    policy, tier, kind, zoom = _of(POLICIES, k % 4), _of(TIERS, k % 3), _of(KINDS, k % 5), _of(ZOOMS, F.floor(k / 4) % 4)
    text = V.retrieval_text(F.concat(F.lit(" "), c("o_orderpriority")), F.when(k % 2 == 0, F.concat(c("o_orderstatus"), F.lit(" "))))
    return o.select(
        "o_orderkey", V.needs_patches(policy).alias("patches"), V.with_grandparent(tier, kind).alias("grandparent"), V.parent_zoom(zoom).alias("parent"), text.alias("text"),
        V.enriched(c("o_orderstatus"), c("o_orderpriority"), F.when(k % 3 == 0, "").otherwise("tumour")).alias("enriched"), V.should_retry((k % 100) / 100).alias("retry"),
        V.is_tissue(F.array(*[((k * i) % 256).cast("int") for i in (1, 7, 13)])).alias("tissue"),
    )


def visual_evidence(spark, sf):
    e = table(spark, sf, "events")
    asked = e.select((c("user_id") % 60).alias("slide_id"), c("event_id").alias("node_id"), _of(V.METHODS, c("event_id") % 4).alias("method"), _of(POLICIES, F.floor(c("event_id") / 4) % 4).alias("policy"))
    s = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0")
    cache = s.select(c("s_suppkey").alias("slide_id"), F.when(c("s_suppkey") % 5 != 0, F.concat(F.lit("t/"), c("s_suppkey").cast("string"))).alias("thumbnail"), F.when(c("s_suppkey") % 2 == 0, F.array_repeat(F.lit(0.5), (c("s_suppkey") % 7 + 1).cast("int"))).alias("embedding"))
    patches = table(spark, sf, "part").select((c("p_partkey") % 100).alias("slide_id"), (-c("p_size")).alias("rank"), F.concat(F.lit("p/"), F.lpad(c("p_partkey").cast("string"), 9, "0")).alias("path"))
    return V.evidence(asked, cache, patches, form=lambda paths: F.array_join(paths, ",")).select("node_id", "slide_id", "method", "thumbnail", "embedding_dim", "paths", "n_paths")


def selection_records(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey").cast("string")
    skipped = F.when(c("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("s"), k))).otherwise(F.array().cast("array<string>"))
    r = o.select(V.selection_record(k, F.array(F.concat(F.lit("a"), k), F.concat(F.lit("b"), k)), F.concat(F.lit("b"), k), c("o_orderpriority"), F.lit("llm"), skipped).alias("r"))
    return r.select("r.case_key", F.array_join("r.physical_slides", ",").alias("slides"), "r.chosen_slide_id", "r.rationale", "r.selection_method", "r.fusion", F.array_join("r.skipped_slides", ",").alias("skipped"))


RAWS, OPTION_SETS = (" Not_Mentioned. ", "`not_mentioned`", "unsure", "", "else"), (("a", "unsure", "none_of_above"), ("none_of_above", "b"), ("b", "not_mentioned"), ("benign", "b"), ("b",))


def fallback_answers(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    options = F.get(F.array(*[F.array(*map(F.lit, s)) for s in OPTION_SETS]), (F.floor(k / 5) % 5).cast("int"))
    return o.select("o_orderkey", X.fallback_answer(_of(RAWS, k % 5), options, F.lit("benign")).alias("answer"))


def retried_answers(spark, sf):
    """The call, its fallback, the retry, its fallback; null is an error."""
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    options = F.array(F.lit("yes_it_is"), F.lit("no_it_isnt"), F.lit("unsure"))
    first, again = _of(("Yes it is", "nothing", "not_mentioned", "yes no"), k % 4), _of(("no_it_isnt", "also nothing", '{"answer": "unsure"}'), F.floor(k / 4) % 3)
    return o.select("o_orderkey", X.extracted([first, again], options, options, F.lit("single_select"), F.lit("benign")).alias("answer"))


def _walked(spark, sf):
    nodes, edges = _graph(spark)
    at = F.get(F.array(*[F.lit(n[0]) for n in NODES]), (c("event_id") % len(NODES)).cast("int"))
    e = table(spark, sf, "events").withColumn("node_id", at).groupBy(c("user_id").alias("case"), "node_id").agg(F.min(F.struct("event_id", "event_type")).alias("m"))
    return X.walk(e.select("case", "node_id", F.when(c("m.event_id") % 11 != 0, c("m.event_type")).alias("answer")), nodes, edges, "start")


def graph_walk_routed(spark, sf):
    return _walked(spark, sf).select("case", "depth", "node_id", "answer", "status")


def chain_records(spark, sf):
    steps = _walked(spark, sf).withColumn("question", F.concat(F.lit("what of "), c("node_id")))
    reports = table(spark, sf, "customer").select(c("c_custkey").alias("case"), F.when(c("c_custkey") % 2 == 0, "test").otherwise("train").alias("split"), c("c_name").alias("report"))
    return X.chain_records(steps, reports).select("slide_id", "split", F.array_join("node_path", ">").alias("path"), F.size("chain").alias("n_steps"), "report", "extraction_status", "error")


def _triples(spark, sf, *more):
    li = table(spark, sf, "lineitem")
    part = F.concat(F.lit("p"), c("l_partkey").cast("string"))
    return li.select(c("l_orderkey").alias("passage"), c("l_linenumber").alias("pos"), part.alias("sub"), c("l_returnflag").alias("rel"), F.when(c("l_linenumber") == 5, part).otherwise(F.concat(F.lit("s"), c("l_suppkey").cast("string"))).alias("obj"), *more)


def phrase_ids(spark, sf):
    return K.phrases(_triples(spark, sf)).select("phrase", "idx")


def kg_build(spark, sf):
    p = table(spark, sf, "part").where("p_size % 7 = 0")
    synonyms = p.select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("a"), F.concat(F.lit("p"), (c("p_partkey") + 1).cast("string")).alias("b"))
    return K.build(_triples(spark, sf), synonyms).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.substring("src", 2, 20).cast("long")).alias("src_sum"), F.sum(F.substring("dst", 2, 20).cast("long")).alias("dst_sum"))


def graph_seeds(spark, sf):
    t = _triples(spark, sf, F.round(c("l_discount") * 10 - 0.3, 6).alias("sim"), (c("l_quantity") > 25).alias("keep"))
    found, without = K.seeds(t.withColumnRenamed("passage", "query_id"))
    return found.select("query_id", "phrase", F.round("score", 6).alias("score")).union(without.select("query_id", F.lit(None).cast("string"), F.lit(None).cast("double")))


def passages_by_way(spark, sf):
    e = table(spark, sf, "events")
    dense = e.select(c("user_id").alias("query_id"), c("event_id").alias("passage"), F.round("value", 4).alias("score"))
    without = e.select(c("user_id").alias("query_id")).where("query_id % 3 = 0").distinct()
    return K.passages(dense, dense.withColumn("score", F.round(100 - c("score"), 4)), without, c("passage") % 5 == 0, 4).select("query_id", "passage", "score", "way", "rank")


_LIST = lambda v: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + "]"
_W = f"""WITH RECURSIVE {_E}, a AS (SELECT user_id AS ca, id AS node, k, min(event_id) AS ev, arg_min(event_type, event_id) AS t FROM events JOIN n ON event_id % 7 = i GROUP BY ALL),
 b AS (SELECT ca, node, k, CASE WHEN ev % 11 <> 0 THEN t END AS answer FROM a),
 h AS (SELECT ca, node, b.answer, CASE WHEN b.answer IS NULL THEN 'no_answer' WHEN k IN ('single_select', 'boolean') AND x.dst IS NULL THEN 'invalid'
   WHEN node = 'report' OR nx IS NULL OR nx = 'report' THEN 'end' ELSE 'step' END AS how, nx FROM (SELECT b.*, x.dst, CASE k WHEN 'multi_select' THEN coalesce(d.dst, x.dst) WHEN 'free_text' THEN d.dst ELSE x.dst END AS nx
   FROM b LEFT JOIN g x ON x.src = node AND x.answer = b.answer LEFT JOIN g d ON d.src = node AND d.answer = '__default__') b LEFT JOIN g x ON x.src = node AND x.answer = b.answer),
 w(ca, depth, node, path) AS (SELECT DISTINCT ca, 0, 'start', ['start'] FROM h UNION ALL SELECT w.ca, depth + 1, nx, list_append(path, nx) FROM w JOIN h ON h.ca = w.ca AND h.node = w.node
   WHERE how = 'step' AND depth < 64 AND NOT list_contains(path[1:-2], w.node)),
 s AS (SELECT w.ca AS "case", depth, w.node AS node_id, h.answer, CASE WHEN depth >= 64 THEN 'too_long' WHEN list_contains(path[1:-2], w.node) THEN 'cycle' ELSE coalesce(how, 'no_answer') END AS status FROM w LEFT JOIN h ON h.ca = w.ca AND h.node = w.node)"""
_T = "t AS (SELECT l_orderkey AS passage, l_linenumber AS pos, 'p' || l_partkey AS sub, l_returnflag AS rel, CASE WHEN l_linenumber = 5 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS obj, round(l_discount * 10 - 0.3, 6) AS sim, l_quantity > 25 AS keep FROM lineitem)"
_H = f"{_T}, u AS (SELECT sub AS phrase, passage, pos, 0 AS side FROM t UNION ALL SELECT obj, passage, pos, 1 FROM t), f AS (SELECT DISTINCT ON (phrase) phrase, passage, pos, side FROM u ORDER BY phrase, passage, pos, side), ids AS (SELECT phrase, row_number() OVER (ORDER BY passage, pos, side, phrase) - 1 AS idx FROM f)"
ORACLES = {
    "node_policies": f"""SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS patches, lower(coalesce({_LIST(TIERS)}[o_orderkey % 3 + 1], '')) = 'integration' OR o_orderkey % 5 IN (0, 1) AS grandparent,
 ['20x', '10x', '5x', NULL][o_orderkey // 4 % 4 + 1] AS parent, trim(o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || trim(o_orderstatus) ELSE '' END AS text,
 trim('[' || o_orderstatus || '] ' || o_orderpriority || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'tumour' END) AS enriched, (o_orderkey % 100) / 100 < 0.65::DOUBLE AS retry,
 (o_orderkey % 256 + o_orderkey * 7 % 256 + o_orderkey * 13 % 256) / 3 <= 220 AS tissue FROM orders""",
    "visual_evidence": f"""WITH a AS (SELECT user_id % 60 AS slide_id, event_id AS node_id, {_LIST(V.METHODS)}[event_id % 4 + 1] AS method, event_id // 4 % 4 IN (0, 1) AS needs FROM events),
 p AS (SELECT p_partkey % 100 AS slide_id, list('p/' || lpad(p_partkey::VARCHAR, 9, '0') ORDER BY -p_size, p_partkey) AS paths FROM part GROUP BY 1),
 j AS (SELECT a.*, s_suppkey AS s, coalesce(paths, []) AS paths FROM a LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = a.slide_id LEFT JOIN p ON p.slide_id = a.slide_id),
 k AS (SELECT *, CASE WHEN method = 'patch_retrieve' AND needs THEN paths WHEN method = 'slide_embed' THEN paths[1:3] ELSE [] END AS shown FROM j)
 SELECT node_id, slide_id, method, CASE WHEN method <> 'none' AND s % 5 <> 0 THEN 't/' || s END AS thumbnail, CASE WHEN method = 'slide_embed' AND s % 2 = 0 THEN (s % 7 + 1)::INT END AS embedding_dim, array_to_string(shown, ',') AS paths, len(shown)::INT AS n_paths FROM k""",
    "selection_records": "SELECT o_orderkey::VARCHAR AS case_key, 'a' || o_orderkey || ',b' || o_orderkey AS slides, 'b' || o_orderkey AS chosen_slide_id, o_orderpriority AS rationale, 'llm' AS selection_method, 'ss_llm_pick' AS fusion, CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey END AS skipped FROM orders",
    "fallback_answers": f"WITH r AS (SELECT o_orderkey, {_LIST(RAWS)}[o_orderkey % 5 + 1] AS raw, [{', '.join(map(_LIST, OPTION_SETS))}][o_orderkey // 5 % 5 + 1] AS opts FROM orders) SELECT o_orderkey, CASE WHEN trim(lower(raw), '`\"'' .,;') = 'not_mentioned' THEN coalesce(list_filter(['unsure', 'none_of_above', 'not_mentioned'], lambda x: list_contains(opts, x))[1], CASE WHEN list_contains(opts, 'benign') THEN 'benign' END) END AS answer FROM r",
    "retried_answers": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'yes_it_is' WHEN 2 THEN 'unsure' ELSE ['no_it_isnt', NULL, 'unsure'][o_orderkey // 4 % 3 + 1] END AS answer FROM orders",
    "graph_walk_routed": f'{_W} SELECT "case", depth, node_id, answer, status FROM s',
    "chain_records": f"""{_W}, r AS (SELECT "case", string_agg(node_id, '>' ORDER BY depth) FILTER (status IN ('step', 'end')) AS path, count(*) FILTER (status IN ('step', 'end')) AS n, arg_max(status, depth) AS last, arg_max(node_id, depth) AS node FROM s GROUP BY 1)
 SELECT "case" AS slide_id, CASE WHEN "case" % 2 = 0 THEN 'test' ELSE 'train' END AS split, coalesce(path, '') AS path, n::INT AS n_steps, c_name AS report, CASE WHEN last IN ('step', 'end') THEN 'ok' ELSE 'failed' END AS extraction_status, CASE WHEN last NOT IN ('step', 'end') THEN last || ' at ' || node END AS error FROM r JOIN customer ON c_custkey = "case" """,
    "phrase_ids": f"WITH {_H} SELECT phrase, idx FROM ids",
    "kg_build": f"""WITH {_H}, x AS (SELECT passage, rel, a.idx AS s, b.idx AS o FROM t JOIN ids a ON a.phrase = sub JOIN ids b ON b.phrase = obj), c AS (SELECT DISTINCT passage, s AS h FROM x UNION SELECT DISTINCT passage, o FROM x),
 y AS (SELECT a.idx AS s, b.idx AS o FROM part JOIN ids a ON a.phrase = 'p' || p_partkey JOIN ids b ON b.phrase = 'p' || (p_partkey + 1) WHERE p_size % 7 = 0),
 e AS (SELECT s, o, 'relation' AS type, rel AS label FROM x WHERE s <> o UNION ALL SELECT o, s, 'relation', 'inv_' || rel FROM x WHERE s <> o UNION ALL SELECT passage, h, 'contains', 'contains' FROM c UNION ALL SELECT h, passage, 'is_in', 'is_in' FROM c UNION ALL SELECT s, o, 'synonym', 'synonym' FROM y UNION ALL SELECT o, s, 'synonym', 'synonym' FROM y)
 SELECT type, label, count(*) AS n, sum(s)::BIGINT AS src_sum, sum(o)::BIGINT AS dst_sum FROM e GROUP BY 1, 2""",
    "graph_seeds": f"""WITH {_T}, b AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY sim DESC, pos DESC, sub, obj) AS r FROM t), u AS (SELECT passage, sub AS phrase, sim FROM b WHERE r <= 5 AND keep UNION ALL SELECT passage, obj, sim FROM b WHERE r <= 5 AND keep),
 m AS (SELECT passage, phrase, avg(sim) AS score FROM u GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY score DESC, phrase) AS r FROM m)
 SELECT passage AS query_id, phrase, round(score, 6) AS score FROM f WHERE r <= 5 UNION ALL SELECT passage, NULL, NULL FROM (SELECT DISTINCT passage FROM t) WHERE passage NOT IN (SELECT passage FROM m)""",
    "passages_by_way": "WITH e AS (SELECT user_id AS query_id, event_id AS passage, CASE WHEN user_id % 3 = 0 THEN round(value, 4) ELSE round(100 - round(value, 4), 4) END AS score, CASE WHEN user_id % 3 = 0 THEN 'dense' ELSE 'graph' END AS way FROM events WHERE event_id % 5 <> 0) SELECT query_id, passage, score, way, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage) AS rank FROM e) WHERE rank <= 4",
}
QUERIES = {n: globals()[n] for n in ORACLES}
