"""Records, prompts and exports over the stand-in tables."""

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import plugins as P
from marlstone.operators import records as R
from marlstone.operators import resolve as J
from marlstone.plans.base import pool, table

c = F.col


def _steps(spark, sf):
    t = table(spark, sf, "conversations")
    kind = F.get(F.array(*map(F.lit, ("single_select", "free_text", "boolean"))), (c("turn") % 3).cast("int"))
    ans = F.when(c("turn") % 4 == 3, "").when(c("conv_id") % 3 == 0, F.when(c("turn") == 1, "no invasion").otherwise("deep invasion")).otherwise(c("text"))
    return t.select(c("conv_id").alias("case"), c("turn").alias("pos"), F.concat(F.lit("n"), c("turn").cast("string")).alias("node_id"), c("text").alias("question"), ans.alias("answer"), kind.alias("interaction"))


def _chains(spark, sf):
    s = _steps(spark, sf)
    ch = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.when(c("pos") == 4, "report").otherwise(c("node_id")).alias("node_id"), "question", "answer").alias("s")))), lambda x: x["s"])
    return s.groupBy(c("case").alias("slide_id")).agg(ch.alias("chain")).withColumns({"report": F.when(c("slide_id") % 5 == 0, F.lit(" final ")), "node_path": F.lit(None).cast("array<string>")})


def flatten_evidence(spark, sf):
    p = pool(spark, sf).select(c("id").alias("rank"), F.concat(F.lit("p/"), c("id").cast("string")).alias("patch_path"), F.when(c("id") % 2 == 0, F.concat(F.lit("m/"), c("id").cast("string"))).alias("parent_path"), F.when(c("id") % 3 == 0, "").otherwise("g").alias("grandparent_path"))
    return R.flatten_evidence(p)


def eval_record(spark, sf):
    r = R.eval_record(_chains(spark, sf))
    return r.select("slide_id", F.array_join("node_path", ">").alias("path"), "report", F.size(R.without_report(c("chain"))).alias("n_steps"))


def selection_prompts(spark, sf):
    ch = _chains(spark, sf)
    cands = ch.select((c("slide_id") % 10).alias("case_key"), c("slide_id").alias("pos"), c("slide_id").cast("string").alias("slide_id"), R.chain_text(c("chain"), F.coalesce("report", F.lit(""))).alias("text"))
    return R.selection_prompt(cands).select("case_key", F.sha2("prompt", 256).alias("prompt_sha"))


def step_prompts(spark, sf):
    s = _steps(spark, sf)
    return s.select("case", "pos", R.sections(c("question"), F.lit(""), c("answer"), R.visual_note((c("pos") % 3).cast("int"), (c("pos") % 2).cast("int"))).alias("prompt"), T.shorten(c("question"), 6).alias("short"))


def format_hits(spark, sf):
    d = table(spark, sf, "documents")  # thirty hits a query at any size
    return R.format_hits(d.select(F.floor(c("doc_id") / 30).alias("query_id"), (c("doc_id") % 30).alias("rank"), c("source").alias("title"), "text"))


def training_samples(spark, sf):
    s = R.training_samples(_steps(spark, sf))
    return s.select("case", "pos", "episodic_context", R.chat_sample(F.lit("sys"), c("question"), c("answer")).alias("sample"))


def selector_response(spark, sf):
    o = table(spark, sf, "orders")
    resp = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit('{"slide_id": " '), c("o_orderstatus"), F.lit('"}'))).when(c("o_orderkey") % 3 == 1, '{"slide_id": "Z"}').otherwise("text")
    return o.select("o_orderkey", R.selected(resp, F.array(F.lit("F"), F.lit("O")), F.lit("first")).alias("chosen"))


def paired_anchor(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", R.paired_anchor(F.when(c("event_id") % 3 == 0, "early"), F.when(c("event_id") % 2 == 0, "own"), (c("event_id") % 4).cast("int")).alias("anchor"), F.round(P.confidence(F.when(c("event_id") % 5 == 0, -c("value") / 10)), 6).alias("confidence"))


def level_report(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).select("p_size", "n", R.magnification(F.lit(0.25), c("p_size").cast("double")).alias("magnification"))


def spread_labels(spark, sf):
    p = table(spark, sf, "part").select(c("p_partkey").alias("id"), c("p_size").alias("bin"), F.round(c("p_retailprice") / 10, 2).alias("y"))
    return R.spread_labels(p, 3.0)


def consistency_break(spark, sf):
    return R.consistency_break(_steps(spark, sf)).select("case", "pos", "inconsistent")


def count_mismatch(spark, sf):
    li = table(spark, sf, "lineitem")
    return R.consistent_counts(li.where("l_quantity > 10").select("l_orderkey"), li.where("l_discount > 0.02").select("l_orderkey"), "l_orderkey")


def specimen_key_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", T.specimen(F.concat(F.lit("tu-"), c("s_suppkey").cast("string"), F.lit("-A"))).alias("k"))
    k = table(spark, sf, "customer").select(T.padded(c("c_custkey").cast("string")).alias("number"), "c_name")
    return s.select("s_suppkey", "k.prefix", "k.number", "k.block").join(k, "number", "left")


def report_pick(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", J.pick_report(F.when(c("o_orderkey") % 2 == 0, "  "), F.when(c("o_orderkey") % 3 == 0, c("o_orderstatus")), c("o_orderpriority")).alias("report"))


_S = "s AS (SELECT conv_id AS \"case\", turn AS pos, 'n' || turn AS node_id, text AS question, CASE WHEN turn % 4 = 3 THEN '' WHEN conv_id % 3 = 0 THEN CASE WHEN turn = 1 THEN 'no invasion' ELSE 'deep invasion' END ELSE text END AS answer, ['single_select', 'free_text', 'boolean'][turn % 3 + 1] AS interaction FROM conversations)"
ORACLES = {
    "flatten_evidence": "WITH p AS (SELECT vec_id AS rank FROM embeddings) SELECT rank, 'patch' AS scale, 'p/' || rank AS path, rank * 3 AS ord FROM p UNION ALL SELECT rank, 'parent', 'm/' || rank, rank * 3 + 1 FROM p WHERE rank % 2 = 0 UNION ALL SELECT rank, 'grandparent', 'g', rank * 3 + 2 FROM p WHERE rank % 3 <> 0",
    "eval_record": f"WITH {_S}, r AS (SELECT \"case\" AS slide_id, string_agg(CASE WHEN pos = 4 THEN 'report' ELSE node_id END, '>' ORDER BY pos) AS path, count(*) FILTER (pos <> 4) AS n, max(pos) AS last, arg_max(answer, pos) AS a FROM s GROUP BY 1) SELECT slide_id, path, CASE WHEN slide_id % 5 = 0 THEN ' final ' WHEN last = 4 THEN a ELSE '' END AS report, CAST(n AS INT) AS n_steps FROM r",
    "selection_prompts": f"WITH {_S}, t AS (SELECT \"case\" AS id, string_agg(CASE WHEN pos = 4 THEN 'report' ELSE node_id END || ': ' || question || ' -> ' || answer, chr(10) ORDER BY pos) || CASE WHEN \"case\" % 5 = 0 THEN chr(10) || 'Per-slide report: final' ELSE '' END AS x FROM s GROUP BY 1) SELECT id % 10 AS case_key, sha256('Select the case-level chain from these candidates:' || chr(10) || chr(10) || string_agg('## Slide ' || id || chr(10) || x, chr(10) || chr(10) ORDER BY id)) AS prompt_sha FROM t GROUP BY 1",
    "step_prompts": f"WITH {_S} SELECT \"case\", pos, concat_ws(chr(10) || chr(10), nullif(trim(question), ''), nullif(trim(answer), ''), nullif(concat_ws(', ', CASE WHEN pos % 2 > 0 THEN (pos % 2) || ' thumbnail(s)' END, CASE WHEN pos % 3 > 0 THEN (pos % 3) || ' patch(es)' END), '')) AS prompt, CASE WHEN length(question) > 6 THEN substring(question, 1, 5) || '…' ELSE question END AS short FROM s",
    "format_hits": "SELECT doc_id // 30 AS query_id, string_agg('[' || (doc_id % 30) || '] ' || source || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY doc_id % 30) AS context FROM documents GROUP BY 1",
    "training_samples": f"WITH {_S}, w AS (SELECT *, coalesce(string_agg(CASE WHEN answer <> '' THEN node_id || '=' || answer END, '; ') OVER (PARTITION BY \"case\" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS e FROM s) SELECT \"case\", pos, e AS episodic_context, '{{\"messages\":[{{\"role\":\"system\",\"content\":\"sys\"}},{{\"role\":\"user\",\"content\":' || to_json(question)::VARCHAR || '}},{{\"role\":\"assistant\",\"content\":' || to_json(answer)::VARCHAR || '}}]}}' AS sample FROM w WHERE interaction <> 'free_text' AND answer <> ''",
    "selector_response": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'first' END AS chosen FROM orders",
    "paired_anchor": "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'early' END, CASE WHEN event_id % 4 >= 1 AND event_id % 2 = 0 THEN 'own' END) AS anchor, round(CASE WHEN event_id % 5 = 0 THEN exp(-value / 10) ELSE 1.0 END, 6) AS confidence FROM events",
    "level_report": "SELECT p_size, count(*) AS n, round(0.5::DOUBLE / (0.25::DOUBLE * p_size) * 20, 3) AS magnification FROM part GROUP BY p_size",
    "spread_labels": "WITH p AS (SELECT p_partkey AS id, p_size AS bin, round(p_retailprice / 10, 2) AS y FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY y, id) AS i FROM p) SELECT id, bin, y, round(max(y - i * 3.0::DOUBLE) OVER (PARTITION BY bin ORDER BY y, id ROWS UNBOUNDED PRECEDING) + i * 3.0::DOUBLE, 6) AS placed FROM n",
    "consistency_break": f"WITH {_S}, w AS (SELECT *, coalesce(bool_or(lower(answer) LIKE '%no invasion%') OVER (PARTITION BY \"case\" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS b FROM s) SELECT \"case\", pos, b AND lower(answer) LIKE '%invasion%' AND lower(answer) NOT LIKE '%no %' AS inconsistent FROM w",
    "count_mismatch": "SELECT l_orderkey, count(*) FILTER (l_quantity > 10) AS vectors, count(*) FILTER (l_discount > 0.02) AS coords FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 10) <> count(*) FILTER (l_discount > 0.02)",
    "specimen_key_join": "SELECT s_suppkey, 'TU' AS prefix, lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INT, '0') AS number, 'A' AS block, c_name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey",
    "report_pick": "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, o_orderpriority) AS report FROM orders",
}
QUERIES = {n: globals()[n] for n in ORACLES}
