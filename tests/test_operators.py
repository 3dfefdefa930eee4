import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import context as C
from marlstone.operators import geometry as G
from marlstone.operators import graph as Gr
from marlstone.operators import metrics as M
from marlstone.operators import plugins as P
from marlstone.operators import resolve as R
from marlstone.operators import retrieval as I
from marlstone.operators import vectors as V
from marlstone.sources import readers, sinks


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first().x


def test_diverse_equals_a_sequential_twin(spark):
    rng = random.Random(1)
    rows = [(q, i + 1, i, float(rng.randrange(20) * 512), float(rng.randrange(20) * 512), 1 - i / 100) for q in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, x double, y double, sim double")
    got = {(r.query_id, r.id) for r in V.diverse(df, 1024.0, 6).collect()}
    want = set()
    for q in range(4):
        taken = []
        for r in sorted(x for x in rows if x[0] == q):
            if len(taken) < 6 and all(math.dist(r[3:5], t[3:5]) > 1024 for t in taken):
                taken.append(r)
        want |= {(q, t[2]) for t in taken}
    assert got == want


@pytest.mark.parametrize("n,k,grid", [(50, 100, 4), (300, 64, 4), (200, 3, 4), (500, 200, 8)])
def test_stratified_sample_covers_the_grid(spark, n, k, grid):
    """Its rule is held against SQL in test_queries; here, what any such sample must keep."""
    rng = random.Random(n)
    pts = {i: (rng.randrange(9000) if i % 5 else 10, rng.randrange(7000)) for i in range(n)}
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in pts.items()], "slide_id int, ord long, x long, y long")
    got = [(r.ord, r.x, r.y) for r in G.stratified_sample(df, k, grid, grid, 512).collect()]
    assert len({o for o, _, _ in got}) == len(got) == min(n, k) and all(pts[o] == (x, y) for o, x, y in got)
    x0, y0, x1, y1 = (f(p[d] for p in pts.values()) for f in (min, max) for d in (0, 1))
    cell = lambda x, y: (min((y - y0) * grid // (y1 - y0), grid - 1), min((x - x0) * grid // (x1 - x0), grid - 1))
    have, all_cells = {cell(x, y) for _, x, y in got}, {cell(*p) for p in pts.values()}
    assert len(have) >= min(k, len(all_cells))


def test_min_distance_relaxes_once(spark):
    s = spark.createDataFrame([(0, 1, 0.9, 10.0), (0, 2, 0.8, 60.0), (1, 3, 0.7, 150.0), (2, 4, 0.5, 3.0)], "query_id long, id long, sim double, d double")
    assert {r.id for r in V.away_from(s, 100.0).collect()} == {2, 3}


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<float>")
    got = {(r.id_a, r.id_b) for r in V.similar_pairs(df, 0.8, block_rows=20).collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-8
    s = np.round(u @ u.T, 6)
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.8}


def test_pagerank_both_ways_and_sums_to_one(spark):
    rng = random.Random(3)
    e = [(f"n{rng.randrange(12)}", f"n{rng.randrange(14)}") for _ in range(40)]
    edges = spark.createDataFrame(e, "src string, dst string")
    reset = spark.createDataFrame([("n0", 0.7), ("n3", 0.3)], "node string, reset double")
    a = {r.node: r.score for r in Gr.pagerank(edges, reset).collect()}
    b = {r.node: r.score for r in Gr.pagerank(edges, reset, small_edges=0, rounds=20).collect()}
    assert sum(a.values()) == pytest.approx(1) and a == pytest.approx(b)


@pytest.mark.parametrize("p,g,f", [("a b c d", "a x c d", 6 / 8), ("", "a", 0.0), ("a a b", "b a a", 4 / 6)])
def test_rouge_l(spark, p, g, f):
    df = spark.createDataFrame([(p, g)], "p string, g string")
    assert M.rouge_l(df, "p", "g").first().rouge_l == pytest.approx(f, abs=1e-6)


def test_bleu_is_one_for_equal_texts_and_falls(spark):
    b = lambda p, g: one(spark, M.bleu4(F.col("p"), F.col("g")), p=p, g=g)
    assert b("one two three four five", "one two three four five") == pytest.approx(1)
    assert 0 < b("one two three nine five", "one two three four five") < 1 and b("x", "y") == 0


@pytest.mark.parametrize("p,g,want", [("3 mm and 7cm", "3mm", 1.0), ("4mm", "3mm 3mm", 0.0), ("none", "no numbers", 1.0), ("3mm", "3mm 3mm", 0.5)])
def test_numeric_fidelity(spark, p, g, want):
    assert one(spark, M.numeric_fidelity(F.col("p"), F.col("g")), p=p, g=g) == want


@pytest.mark.parametrize("p,g,score,n", [("no sign of any carcinoma", "carcinoma", 0.0, 1), ("no carcinoma", "without carcinoma", 1.0, 1), ("x", "y", 1.0, 0), ("no a b c d carcinoma", "carcinoma", 1.0, 1), ("carcinomafree", "no carcinoma", 1.0, 1)])
def test_negation(spark, p, g, score, n):
    assert tuple(one(spark, M.negation_consistency(F.col("p"), F.col("g")), p=p, g=g)) == (score, n)


@pytest.mark.parametrize("raw,want", [("Well-known, 3.5 mm!", "well known 3.5 mm"), ("a.b", "a b"), ("end.", "end"), ("", "")])
def test_metric_normalize(spark, raw, want):
    assert one(spark, T.metric_normalize(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,kind,want", [("yes", "boolean", "yes"), ("Answer: YES.", "boolean", "yes"), ('{"choice": "no"}', "boolean", "no"), ("perhaps", "boolean", None), ("", "boolean", None), ("no and yes", "multi_select", "no,yes"), (" free ", "free_text", "free")])
def test_answers(spark, raw, kind, want):
    o = F.array(F.lit("yes"), F.lit("no"))
    assert one(spark, T.resolve_answer(F.col("t"), o, o, F.lit(kind)), t=raw) == want


def test_walk_ends_and_finds_cycles(spark):
    edges = spark.createDataFrame([("a", "x", "b"), ("b", "x", "c"), ("b", "y", "a")], "src string, answer string, dst string")
    ans = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y")], "case long, node_id string, answer string")
    got = {(r.case, r.depth): (r.node_id, r.status) for r in Gr.walk(ans, edges, "a").collect()}
    assert got[(1, 2)] == ("c", "end") and got[(2, 2)] == ("a", "cycle")


def test_severity_ties_go_to_slide_order_and_stale_picks_are_ignored(spark):
    rows = [("c", 0, "s0", "benign", "gone"), ("c", 1, "s1", "Malignant", "gone"), ("c", 2, "s2", "malignant", "gone"), ("d", 0, "t0", "x", "t1"), ("d", 1, "t1", None, "t1")]
    got = {r.case_key: (r.chosen, r.method) for r in R.severity_pick(spark.createDataFrame(rows, "case_key string, pos int, slide_id string, diagnosis string, stored_pick string")).collect()}
    assert got == {"c": ("s1", "severity_fallback"), "d": ("t1", "stored")}


def test_retry_stops_at_the_first_sure_answer(spark):
    a = spark.createDataFrame([("c", "n", 1, "x", 0.7), ("c", "n", 2, "y", 0.9), ("c", "m", 1, None, 0.9), ("c", "m", 2, "z", 0.1)], "case string, node_id string, attempt int, answer string, confidence double")
    assert {r.node_id: r.answer for r in C.retry_best(a).collect()} == {"n": "x", "m": "z"}


def test_fingerprint_refuses_another_corpus(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    a, b = I.fingerprint(d).first().fingerprint, I.fingerprint(d, {"k": "1"}).first().fingerprint
    assert a != b and I.require_same(None, a) and not I.require_same(a, a)
    with pytest.raises(ValueError):
        I.require_same(a, b)


def test_readers(spark, tmp_path):
    nodes = [{"id": "a", "question": "q", "description": "d", "node_kind": "global", "options": ["x"], "edges": {"x": "b"}, "retrieval_level": "high"}, {"id": "b", "node_kind": "report", "is_leaf": True, "root": True, "edges": {}}]
    (tmp_path / "g.jsonl").write_text("\n\n".join(map(json.dumps, nodes)))
    n, e, root = readers.read_graph(spark, str(tmp_path / "g.jsonl"))
    assert root == "b" and {r.id: (r.zoom_level, r.visual_policy) for r in n.collect()} == {"a": ("20x", "thumbnail_only"), "b": ("5x", "both")} and e.count() == 1
    chains = [{"slide_id": "s", "qa_chain": [{"q": "Q", "a": "A"}], "final_report": "r"}, {"slide_id": "s", "chain-of-thought": [{"node_id": "n", "question": "q", "answer": "b"}], "report": ""}, {"slide_id": "t,u", "split": "test"}, {"slide_id": "", "extraction_status": "failed"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, chains)))
    rec = readers.eval_records(readers.json_lines(spark, str(tmp_path / "c.jsonl"), readers.CHAIN))
    by = {r.slide_id: r for r in rec.collect()}
    assert by["s"].chain[0].answer == "b" and by["s"].node_path == ["n"]
    assert [r.slides for r in readers.cases(rec, "test").collect()] == [["t", "u"]]
    (tmp_path / "ref").mkdir()
    ref = {"id": "1", "title": "t", "text": "x", "source": "s", "source_type": "reference", "topic": "t", "graph_nodes": ["n"]}
    (tmp_path / "ref" / "r.jsonl").write_text("\n".join(map(json.dumps, [ref, ref | {"source_type": "x"}, {"id": "2"}])) + "\nnot json")
    good, bad = readers.references(spark, str(tmp_path / "ref"))
    assert good.count() == 1 and bad.count() == 3
    with pytest.raises(ValueError):
        readers.strict(good, bad)


def test_spreadsheet(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>b</t></is></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>a</t></si><si><t>hi</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet.replace('r="C1"', 'r="B1"').replace('r="C2"', 'r="B2"'))
        z.writestr("xl/sharedStrings.xml", shared)
    spark.dataSource.register(readers.Spreadsheet)
    assert [tuple(r) for r in spark.read.format("spreadsheet").option("path", str(tmp_path / "x.xlsx")).load().collect()] == [("5", "hi")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sinks.append_missing(df, str(tmp_path / "t"), "k") == 2 and sinks.append_missing(df.union(spark.createDataFrame([(3, "c")], df.schema)), str(tmp_path / "t"), "k") == 1
    sinks.rewrite(df, str(tmp_path / "r"))
    sinks.rewrite(df.limit(1), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1 and spark.read.parquet(str(tmp_path / "r.bak")).count() == 2


def test_plugins(spark):
    p = spark.createDataFrame([("hello", ["x", "y"])], "prompt string, options array<string>")
    assert P.make(P.RETRIEVERS, "cosine") and P.FirstOption().answer(p).first().raw == "x"
    assert P.ModelBackend(lambda: lambda texts: [t.upper() for t in texts]).answer(p).first().raw == "HELLO"
    with pytest.raises(KeyError):
        P.make(P.MEMORIES, "community")
