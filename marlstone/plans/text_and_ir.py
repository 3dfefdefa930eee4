"""Text functions, lexical and hybrid retrieval."""

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import retrieval as R
from marlstone.operators import vectors as V
from marlstone.plans.base import pool, table, vector_queries

c = F.col
OPTIONS = ("serous_carcinoma", "endometrioid carcinoma", "Clear-cell", "none_of_above")
LABELS = ("benign", "malignant", "uncertain")


def metric_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.metric_normalize(F.regexp_replace(c("text"), r"\|", " 3.5mm, well-known ")).alias("norm"))


def canonical_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.canonical_key(c("text")).alias("key"), T.safe_name(c("source")).alias("safe"))


def _answers(spark, sf):
    raw = F.array(*map(F.lit, ('{"answer": "Serous Carcinoma"}', "Answer: clear cell.", "it is an endometrioid carcinoma here", '"none_of_above"', "carcinoma", "serous carcinoma and clear-cell", "", "yes", "label: Endometrioid, serous")))
    kind = F.array(*map(F.lit, ("single_select", "multi_select", "free_text", "boolean")))
    e = table(spark, sf, "events")
    return e.select("event_id", F.get(raw, (c("event_id") % 9).cast("int")).alias("raw"), F.get(kind, (F.floor(c("event_id") / 9) % 4).cast("int")).alias("interaction"))


def answer_resolve(spark, sf):
    opts = F.array(*map(F.lit, OPTIONS))
    return _answers(spark, sf).select("event_id", T.resolve_answer(c("raw"), opts, opts, c("interaction")).alias("answer"))


def soft_json(spark, sf):
    e = table(spark, sf, "events")
    t = F.when(c("event_id") % 3 == 0, F.concat(F.lit("so: "), c("props"), F.lit(" done"))).when(c("event_id") % 3 == 1, c("props")).otherwise("none")
    return e.select("event_id", T.soft_json(t, "k").cast("int").alias("k"), T.unfence(F.concat(F.lit("```json\n"), c("props"), F.lit("\n```"))).alias("plain"))


def null_like_clean(spark, sf):
    v = F.array(*map(F.lit, (" NaN", "n.a.", "x ", "", "None", "Na")))
    return table(spark, sf, "orders").select("o_orderkey", T.null_like(F.get(v, (c("o_orderkey") % 6).cast("int"))).alias("v"), T.null_like(F.get(v, (c("o_orderkey") % 6).cast("int")), "N.A.").alias("na"))


def token_list(spark, sf):
    t = F.concat_ws(";", F.concat(F.lit("a/b/"), c("o_orderstatus")), F.concat(F.lit(" "), c("o_orderpriority")), F.lit("nan"), (c("o_orderkey") % 9).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(T.token_list(t), "|").alias("tokens"))


def label_parse(spark, sf):
    v = F.array(*map(F.lit, ('{"classification": "malignant"}', "looks benign, not malignant", "unsure", '{"classification": "x"} uncertain')))
    return table(spark, sf, "orders").select("o_orderkey", T.label_parse(F.get(v, (c("o_orderkey") % 4).cast("int")), LABELS).alias("label"))


def qa_pairs(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(c("doc_id") % 3 == 0, c("text")).otherwise(F.concat(F.lit("Q1: what "), c("lang"), F.lit("\nA1: it: "), c("source"), F.lit("\nA2: lost\nQ2: more\n\nA2: yes\nFINAL: "), c("lang")))
    return d.select("doc_id", F.posexplode(T.qa_pairs(t)).alias("pos", "s")).select("doc_id", "pos", "s.node_id", "s.question", "s.answer")


def section_chunks(spark, sf):
    d = table(spark, sf, "documents")
    t = F.concat(F.lit("A. First title\nbody."), (c("doc_id") % 90).cast("string"), F.lit(" "), c("lang"), F.lit("\nReferences\n1. x\nB. Second\nmore clefts.2,3 end\n"))
    return d.select("doc_id", F.explode(T.section_chunks(t)).alias("s")).select("doc_id", "s.letter", "s.title", "s.body")


def _docs(spark, sf):
    return table(spark, sf, "documents").select(c("doc_id").alias("id"), "text", "source", "lang")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))


def _lexical(spark, sf, asked, k=20):
    return R.ranked(R.bm25(_docs(spark, sf), asked), k=k)


def bm25_topk(spark, sf):
    return _lexical(spark, sf, _queries(spark, sf), 5).select("query_id", "id", "score", "rank")


def _fused(spark, sf):
    """Every item and every vector; a query that is only one of them has the ranks of that side."""
    dense = V.nearest(pool(spark, sf), vector_queries(spark, sf), 20).select("query_id", "id", "rank")
    return R.fuse([(dense, 0.65), (_lexical(spark, sf, _queries(spark, sf)), 0.35)])


def rrf_fusion(spark, sf):
    return _fused(spark, sf).where("rank <= 10").select("query_id", "id", "score", "rank")


def leak_guard(spark, sf):
    d = _docs(spark, sf)
    ex = F.concat_ws(";", F.lit(" src1 "), F.lit("7"), F.lit("src3,9"))
    return d.select("id", R.leaks(ex, c("source"), c("id").cast("string")).alias("leaks"), R.leaks_chain(c("id").cast("string"), c("source"), F.lit("12,55")).alias("chain"))


def _reranked(spark, sf, asked):
    d = _docs(spark, sf).select("id", (c("source").isin("src0", "src4")).alias("is_reference"), (c("lang") == "fr").alias("node_match"))
    hits = _lexical(spark, sf, asked).join(d, "id").withColumn("prefer", c("query_id") % 2 == 0)
    return R.rerank(hits, R.depth_k(F.when(c("query_id") % 3 == 0, "5x").otherwise("20x"), F.lit(4))).select("query_id", "id", c("new_rank").alias("rank"))


def reference_rerank(spark, sf):
    return _reranked(spark, sf, _queries(spark, sf))


def _hybrid(spark, sf, f):
    d = _docs(spark, sf).select("id", "source", (c("source") == "src2").alias("is_reference"), F.lit(False).alias("node_match"))
    return R.rerank(f.join(d, "id").where(~R.leaks(F.lit("src1;src5"), c("source"))).withColumn("prefer", F.lit(True)), 5).select("query_id", "id", c("new_rank").alias("rank"))


def hybrid_topk(spark, sf):
    return _hybrid(spark, sf, _fused(spark, sf))


def corpus_fingerprint(spark, sf):
    return R.fingerprint(_docs(spark, sf), {"model": "none"}, buckets=16)


_BM = """d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
 p AS (SELECT term, id, count(*) AS tf, any_value(l) AS len FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY term, id), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
 b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY query_id, id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""
_DENSE = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), ds AS (SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-8) * (sqrt(list_inner_product(b.v, b.v)) + 1e-8)), 6) AS sim FROM e a, e b), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM ds), fu AS (SELECT query_id, id, round(sum(x), 9) AS score FROM (SELECT query_id, id, 0.65 / (60 + rank) AS x FROM dr WHERE rank <= 20 UNION ALL SELECT query_id, id, 0.35 / (60 + rank) FROM r WHERE rank <= 20) GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu)"
ORACLES = {
    "canonical_key": "SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS key, regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM documents",
    "soft_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k')::INT END AS k, props AS plain FROM events",
    "null_like_clean": "WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 THEN 'x' END AS v FROM orders) SELECT o_orderkey, v, coalesce(v, 'N.A.') AS na FROM v",
    "token_list": "SELECT o_orderkey, array_to_string([o_orderstatus, o_orderpriority, (o_orderkey % 9)::VARCHAR], '|') AS tokens FROM orders",
    "label_parse": "SELECT o_orderkey, ['malignant', 'benign', 'insufficient_or_uncertain', 'uncertain'][o_orderkey % 4 + 1] AS label FROM orders",
    "section_chunks": "SELECT doc_id, 'A' AS letter, 'First title' AS title, 'body. ' || lang AS body FROM documents UNION ALL SELECT doc_id, 'B', 'Second', 'more clefts. end' FROM documents",
    "answer_resolve": """WITH a AS (SELECT event_id, event_id % 9 AS r, (event_id // 9) % 4 AS k FROM events)
 SELECT event_id, CASE k WHEN 2 THEN ['{"answer": "Serous Carcinoma"}', 'Answer: clear cell.', 'it is an endometrioid carcinoma here', '"none_of_above"', 'carcinoma', 'serous carcinoma and clear-cell', NULL, 'yes', 'label: Endometrioid, serous'][r + 1]
  WHEN 1 THEN ['serous_carcinoma', 'Clear-cell', 'endometrioid carcinoma,serous_carcinoma', 'none_of_above', 'endometrioid carcinoma,serous_carcinoma', 'Clear-cell,serous_carcinoma', NULL, NULL, 'endometrioid carcinoma,serous_carcinoma'][r + 1]
  ELSE ['serous_carcinoma', 'Clear-cell', 'endometrioid carcinoma', 'none_of_above', NULL, NULL, NULL, NULL, NULL][r + 1] END AS answer FROM a""",
    "qa_pairs": """WITH d AS (SELECT doc_id, lang, source, text AS t FROM documents), s AS (
 SELECT doc_id, 0 AS pos, 'naive_oneshot' AS node_id, 'Thumbnail-only diagnosis (no graph)' AS question, trim(t) AS answer FROM d WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 0, 'naive_q1', 'what ' || lang, 'it: ' || source FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1, 'naive_q2', 'more', 'yes' FROM d WHERE doc_id % 3 <> 0
 UNION ALL SELECT doc_id, 2, 'naive_final', 'Final impression', lang FROM d WHERE doc_id % 3 <> 0) SELECT * FROM s""",
    "bm25_topk": f"WITH {_BM} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "rrf_fusion": f"WITH {_BM}, {_DENSE} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 10",
    "leak_guard": "SELECT doc_id AS id, source IN ('src1', 'src3') OR doc_id IN (7, 9) AS leaks, doc_id IN (12, 55) AS chain FROM documents",
    "reference_rerank": f"WITH {_BM}, h AS (SELECT query_id, r.id, rank, query_id % 2 = 0 AS pr, source IN ('src0', 'src4') AS ref, lang = 'fr' AS nm FROM r JOIN documents ON doc_id = r.id WHERE rank <= 20) SELECT query_id, id, CAST(x AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (pr AND ref)::INT DESC, (pr AND nm)::INT DESC, rank) AS x FROM h) WHERE x <= CASE WHEN query_id % 3 = 0 THEN 2 ELSE 8 END",
    "hybrid_topk": f"WITH {_BM}, {_DENSE}, h AS (SELECT query_id, fr.id, rank, source FROM fr JOIN documents ON doc_id = fr.id WHERE source NOT IN ('src1', 'src5')) SELECT query_id, id, CAST(x AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (source = 'src2')::INT DESC, rank) AS x FROM h) WHERE x <= 5",
    "corpus_fingerprint": "WITH h AS (SELECT doc_id % 16 AS b, doc_id AS k, sha256(text) AS h FROM documents), o AS (SELECT b, sha256(string_agg(k || ':' || h, '|' ORDER BY k)) AS h FROM h GROUP BY b) SELECT sha256(string_agg(h, '|' ORDER BY b) || '#model=none') AS fingerprint, count(*) AS buckets FROM o",
    "metric_normalize": r"""WITH t AS (SELECT doc_id, trim(lower(regexp_replace(text, '\|', ' 3.5mm, well-known ', 'g'))) AS t FROM documents),
 a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\p{L})[^\p{L}\p{N}_\s](\p{L})', '\1 \2', 'g'), '(\p{L})[^\p{L}\p{N}_\s](\p{L})', '\1 \2', 'g') AS t FROM t),
 b AS (SELECT doc_id, string_split(t, '') AS cs FROM a),
 k AS (SELECT doc_id, array_to_string(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN regexp_matches(cs[i], '[^\p{L}\p{N}_\s]') AND NOT regexp_matches(coalesce(cs[i - 1], ''), '\p{Nd}') AND NOT regexp_matches(coalesce(cs[i + 1], ''), '\p{Nd}') THEN '' ELSE cs[i] END), '') AS t FROM b)
 SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS norm FROM k""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
