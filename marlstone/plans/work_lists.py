"""Manifests, name maps, files, sections and gates as work lists."""

from pyspark.sql import functions as F

from marlstone.operators import manifests as M
from marlstone.operators.knowledge import numbered
from marlstone.plans.base import table

c = F.col


def _sheet(spark, sf):
    k = c("c_custkey").cast("string")
    slides = F.when(c("c_custkey") % 7 == 0, " , ").otherwise(F.concat(F.lit("TU_"), k, F.lit(".svs"), F.when(c("c_custkey") % 3 == 0, F.concat(F.lit(" , TU_"), k, F.lit("b.svs"))).otherwise("")))
    return table(spark, sf, "customer").select(F.when(c("c_custkey") % 11 != 0, F.concat(F.lit(" p"), k)).alias("Case"), slides.alias("slide_names"), F.when(c("c_custkey") % 4 == 0, "test").otherwise("train").alias("split"))


def manifest_sheet(spark, sf):
    return M.manifest(_sheet(spark, sf), ("case_id", "Case"), ("slide_ids", "slides", "slide_names"), c("split"))


def name_map_counts(spark, sf):
    o = table(spark, sf, "orders")
    return M.name_map_counts(o.select(F.when(c("o_orderkey") % 9 == 0, "").otherwise(c("o_custkey").cast("string")).alias("case_key"), F.when(c("o_orderkey") % 13 == 0, "1").otherwise("0").alias("report_duplicate")))


def first_source(spark, sf):
    name = lambda t, k, p: table(spark, sf, t).select(F.concat(F.lit(p), c(k).cast("string")).alias("name"))
    return M.first_source([name("orders", "o_orderkey", "o").where("name = 'none'"), name("supplier", "s_suppkey", "s"), name("part", "p_partkey", "p")]).select("name", "source")


def pick_item(spark, sf):
    return M.pick(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), 17, "o_custkey", "o_orderkey")


def files_present(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.lit("TU_"), c("p_partkey").cast("string"))
    files = p.where("p_partkey % 5 <> 0").select(F.concat(F.lit("/b/"), name, F.lit(".svs")).alias("path"))
    files = files.union(p.where("p_partkey % 10 = 0").select(F.concat(F.lit("/a/x/"), name, F.lit("b.SVS")))).union(p.where("p_partkey % 2 = 0").select(F.concat(F.lit("/a/"), name, F.lit(".svs")))).union(p.select(F.concat(F.lit("/a/"), name, F.lit(".png"))))
    return M.file_index(files).select("name", "path")


def cases_present(spark, sf):
    index = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("TU_"), c("p_partkey").cast("string"), F.lit(".svs")).alias("name"))
    index = index.union(table(spark, sf, "part").where("p_partkey % 9 = 0").select(F.concat(F.lit("TU_"), c("p_partkey").cast("string"), F.lit("b.svs"))))
    return M.present(manifest_sheet(spark, sf), index, "slide_ids").select("case_id", "present")


def missing_slides(spark, sf):
    done = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("TU_"), c("c_custkey").cast("string"), F.lit(".svs")).alias("slide_id"))
    return M.missing_of_cases(manifest_sheet(spark, sf), done)


def usable_records(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    r = o.select(F.when(k % 5 != 0, k.cast("string")).alias("slide_id"), F.when(k % 3 == 0, "failed").when(k % 3 == 1, "ok").alias("extraction_status"), F.when(k % 2 == 0, "train").otherwise("test").alias("split"), F.when(k % 7 != 0, F.array(F.lit("step"))).otherwise(F.array().cast("array<string>")).alias("chain"))
    return M.usable(r, "train").select("slide_id")


def section_mismatch(spark, sf):
    found = table(spark, sf, "documents").select(F.substring("source", -1, 1).alias("letter"))
    return M.section_mismatch(found, spark.createDataFrame([(x,) for x in "012XY"], "letter string"))


def stage_gate(spark, sf):
    e = table(spark, sf, "events")
    stages = e.select(c("user_id").alias("slide_id"), c("event_type").alias("stage"), (c("event_id") % 2 == 0).alias("verified"))
    return M.gate(stages, table(spark, sf, "customer").select(c("c_custkey").alias("slide_id")), "purchase")


def level_use(spark, sf):
    li = table(spark, sf, "lineitem")
    steps = table(spark, sf, "events").select(c("user_id").alias("case"), c("event_id").alias("node_id"), (c("user_id") % 50).alias("slide_id"), (c("event_id") % 4).alias("level"))
    images = li.select((c("l_suppkey") % 50).alias("slide_id"), (c("l_linenumber") % 3).cast("long").alias("level"), c("l_linenumber").alias("rank"))
    return M.level_use(steps, images, 3)


def batch_status(spark, sf):
    name = lambda k: F.concat(F.lit("i"), F.lpad((k % 700).cast("string"), 4, "0"))
    done = table(spark, sf, "events").select(name(c("event_id") * 3).alias("name"), c("event_id").alias("at"), F.when(c("event_type") == "error", "failed").otherwise("ok").alias("status"), F.when(c("event_type") == "error", c("props")).alias("error"))
    wanted = table(spark, sf, "orders").select(name(c("o_orderkey")).alias("name"))
    return M.batch_status(wanted, done).select("name", "status", "error", M.backoff(F.length("name").cast("double") + 2).alias("wait"))


def numbered_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return numbered(li, c("l_suppkey").desc(), c("l_orderkey").asc(), c("l_linenumber").asc()).select("l_orderkey", "l_linenumber", "idx")


_M = """m AS (SELECT 'p' || c_custkey AS case_id, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN ['TU_' || c_custkey || '.svs', 'TU_' || c_custkey || 'b.svs'] ELSE ['TU_' || c_custkey || '.svs'] END AS s, CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0)"""
ORACLES = {
    "manifest_sheet": f"WITH {_M} SELECT case_id, array_to_string(s, ',') AS slide_ids, len(s)::INT AS n_slides, split FROM m",
    "name_map_counts": "SELECT count(*) AS slides, count(DISTINCT CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END) AS cases, count(*) FILTER (o_orderkey % 13 = 0) AS duplicates FROM orders",
    "first_source": "SELECT 's' || s_suppkey AS name, 1 AS source FROM supplier",
    "pick_item": "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 1 OFFSET 17",
    "files_present": "WITH f AS (SELECT 'TU_' || p_partkey || '.svs' AS name, CASE WHEN p_partkey % 2 = 0 THEN '/a/' ELSE '/b/' END || 'TU_' || p_partkey || '.svs' AS path FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 0 UNION ALL SELECT 'TU_' || p_partkey || 'b.SVS', '/a/x/TU_' || p_partkey || 'b.SVS' FROM part WHERE p_partkey % 10 = 0) SELECT * FROM f",
    "cases_present": f"WITH {_M} SELECT case_id, (k % 2 = 0 AND k IN (SELECT p_partkey FROM part)) OR (k % 9 = 0 AND k IN (SELECT p_partkey FROM part)) AS present FROM m",
    "missing_slides": f"WITH {_M}, l AS (SELECT case_id, list_filter(s, lambda x: x NOT LIKE '%b.svs' AND k % 2 = 1 OR x LIKE '%b.svs') AS l FROM m) SELECT case_id, array_to_string(l, ',') AS missing FROM l WHERE len(l) > 0",
    "usable_records": "SELECT o_orderkey::VARCHAR AS slide_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0",
    "section_mismatch": "WITH f AS (SELECT DISTINCT right(source, 1) AS letter FROM documents), e AS (SELECT unnest(['0', '1', '2', 'X', 'Y']) AS letter) SELECT letter, 'missing' AS problem FROM e WHERE letter NOT IN (SELECT letter FROM f WHERE letter IS NOT NULL) UNION ALL SELECT letter, 'unexpected' FROM f WHERE letter NOT IN (SELECT letter FROM e)",
    "stage_gate": "WITH s AS (SELECT user_id, bool_or(event_id % 2 = 0) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT c_custkey AS slide_id, coalesce(v, false) AS may_run, CASE WHEN v IS NULL THEN 'not run' WHEN NOT v THEN 'not verified' END AS reason FROM customer LEFT JOIN s ON user_id = c_custkey",
    "level_use": "WITH i AS (SELECT l_suppkey % 50 AS s, l_linenumber % 3 AS l, count(*) AS n FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2) SELECT event_id % 4 AS level, count(*) AS nodes, sum(coalesce(n, 0))::BIGINT AS images FROM events LEFT JOIN i ON s = user_id % 50 AND l = event_id % 4 GROUP BY 1",
    "batch_status": "WITH d AS (SELECT 'i' || lpad((event_id * 3 % 700)::VARCHAR, 4, '0') AS name, arg_max(event_type, event_id) AS t, arg_max(props, event_id) AS p FROM events GROUP BY 1), w AS (SELECT DISTINCT 'i' || lpad((o_orderkey % 700)::VARCHAR, 4, '0') AS name FROM orders) SELECT name, CASE WHEN t IS NULL THEN 'todo' WHEN t = 'error' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN t = 'error' THEN p END AS error, 60.0::DOUBLE AS wait FROM w LEFT JOIN d USING (name)",
    "numbered_rows": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey DESC, l_orderkey, l_linenumber) - 1 AS idx FROM lineitem",
}
QUERIES = {n: globals()[n] for n in ORACLES}
