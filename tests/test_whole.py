"""Queries over whole tables against brute force; they have no SQL or a narrower one."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import metrics as M
from marlstone.operators import vectors as V
from marlstone.plans import evaluation as E
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-8
    ids = np.array([r.vec_id for r in rows])
    xy = np.stack([ids % 32 * 512, ids // 32 * 512], 1)
    return ids, np.array([r.label for r in rows]), xy, np.round(m @ m.T, 6)


def best(ids, sim, ok, k):
    return [ids[j] for j in np.lexsort((ids, -sim)) if ok[j]][:k]


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r.query_id].append(r.id)
    return out


def test_every_vector_is_a_query(spark, vectors):
    ids, label, xy, sim = vectors
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    far = {q: d[i] >= 30000 if (d[i] >= 30000).any() else d[i] >= 15000 for i, q in enumerate(ids)}
    reps = {r.id for r in registry.queries()["nearest_centroid"](spark, SF).collect()}
    cases = {
        "cosine_topk": (5, lambda i, q: np.ones(len(ids), bool)), "cosine_topk_excluding": (5, lambda i, q: ~np.isin(ids, [q, q + 10, 7])),
        "anchor_min_distance_topk": (5, lambda i, q: d[i] >= 2048), "anchor_relax_topk": (5, lambda i, q: far[q]), "representative_pool_topk": (3, lambda i, q: np.isin(ids, list(reps))),
    }
    for name, (k, ok) in cases.items():
        want = {q: w for i, q in enumerate(ids) if (w := best(ids, sim[i], ok(i, q), k))}
        assert by_query(run(spark, name)) == want, name
    got = defaultdict(list)
    for r in sorted(run(spark, "cosine_topk_per_label"), key=lambda r: r["rank"]):
        got[r.query_id, r.slide_id].append(r.id)
    assert got == {(q, v): best(ids, sim[i], label == v, 3) for i, q in enumerate(ids) for v in set(label)}


def test_diverse_walks_the_whole_order(spark, vectors):
    ids, _, xy, sim = vectors
    want = {}
    for i, q in enumerate(ids):
        taken = []
        for j in np.lexsort((ids, -sim[i])):
            if len(taken) < 5 and all(math.dist(xy[j], xy[t]) > 1024 for t in taken):
                taken.append(j)
        want[q] = [ids[j] for j in taken]
    assert by_query(run(spark, "diverse_topk")) == want


def test_diverse_goes_on_behind_many_near_rows(spark):
    # 300 best rows in one place: the other places are behind them
    rows = [(i, [1.0, i / 1e4], 0, 0) for i in range(300)] + [(300 + i, [1.0, 1.0 + i], 5000 * (i + 1), 0) for i in range(3)]
    pool = spark.createDataFrame(rows, "id long, vec array<double>, x long, y long")
    got = V.diverse_nearest(pool, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>"), 1024.0, 5).collect()
    assert [(r["rank"], r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 300), (3, 301), (4, 302)]


def test_tiles_agree_with_one_block(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)]
    p = spark.createDataFrame(rows, "id long, vec array<double>")
    q = p.selectExpr("id AS query_id", "vec AS query")
    one, many = (sorted((r.query_id, r["rank"], r.id, r.sim) for r in V.nearest(p, q, 4, block_rows=b).collect()) for b in (1000, 13))
    assert one == many and len(one) == 360


def bm25_twin(spark):
    docs = {r.doc_id: re.findall(r"\w+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    mean = sum(map(len, docs.values())) / len(docs)
    post = defaultdict(dict)
    for i, w in docs.items():
        for t in w:
            post[t][i] = post[t].get(i, 0) + 1
    out = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        s = defaultdict(float)
        for t in set(re.findall(r"\w+", r.text.lower())):
            idf = math.log(1 + (len(docs) - len(post[t]) + 0.5) / (len(post[t]) + 0.5))
            for i, tf in post[t].items():
                s[i] += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs[i]) / mean))
        out[r.item_id] = sorted(((i, round(v, 6)) for i, v in s.items()), key=lambda x: (-x[1], x[0]))
    return out


def test_every_benchmark_item_is_a_query(spark, vectors):
    want = bm25_twin(spark)
    assert by_query(run(spark, "bm25_topk")) == {q: [i for i, _ in w[:5]] for q, w in want.items() if w}
    info = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    again = {}
    for q, w in want.items():
        key = lambda x: (not (q % 2 == 0 and info[x[1]].source in ("src0", "src4")), not (q % 2 == 0 and info[x[1]].lang == "fr"), x[0])
        again[q] = [i for _, i in sorted(enumerate(i for i, _ in w[:20]), key=key)][: 2 if q % 3 == 0 else 8]
    assert by_query(run(spark, "reference_rerank")) == {q: w for q, w in again.items() if w}
    ids, _, _, sim = vectors
    fused = {}
    for n, q in enumerate(ids):
        s = defaultdict(float)
        for r, i in enumerate(best(ids, sim[n], np.ones(len(ids), bool), 20)):
            s[i] += 0.65 / (61 + r)
        for r, (i, _) in enumerate(want.get(q, [])[:20]):
            s[i] += 0.35 / (61 + r)
        fused[q] = sorted(s, key=lambda i: (-round(s[i], 9), i))
    assert by_query(run(spark, "rrf_fusion")) == {q: w[:10] for q, w in fused.items()}
    ok = lambda i: i in info and info[i].source not in ("src1", "src5")
    hybrid = {q: sorted((i for i in w if ok(i)), key=lambda i: (info[i].source != "src2", w.index(i)))[:5] for q, w in fused.items()}
    assert by_query(run(spark, "hybrid_topk")) == {q: w for q, w in hybrid.items() if w}


def test_graph_holds_all_of_lineitem_and_part(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    parts = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    edges = []
    for r in li:
        a, b = f"p{r.l_partkey}", f"p{r.l_partkey}" if r.l_linenumber == 5 else f"s{r.l_suppkey}"
        if a != b:
            edges += [("relation", r.l_returnflag, a, b), ("relation", f"inv_{r.l_returnflag}", b, a)]
    for o, p in {(f"o{r.l_orderkey}", f"p{r.l_partkey}") for r in li}:
        edges += [("contains", "contains", o, p), ("is_in", "is_in", p, o)]
    for p in parts:
        edges += [("synonym", "synonym", f"p{p}", f"p{p + 1}"), ("synonym", "synonym", f"p{p + 1}", f"p{p}")]
    want = defaultdict(list)
    for t, label, a, b in edges:
        want[t, label].append((a, b))
    assert {(r.type, r.label): (r.n, r.pairs) for r in run(spark, "kg_edges")} == {k: (len(v), len(set(v))) for k, v in want.items()}

    phrase, passage = defaultdict(list), defaultdict(list)
    for r in li:
        phrase[f"p{r.l_partkey}"].append(round(float(r.l_discount) * 10 - 0.3, 6))
        passage[f"o{r.l_orderkey}"].append(float(r.l_tax))
    top = sorted(((-sum(v) / len(v), k) for k, v in phrase.items()))[:5]
    reset = {k: max(0.0, -m) for m, k in top} | {k: 0.05 * max(0.0, round(sum(v) / len(v) - 0.03, 6)) for k, v in passage.items()}
    total = sum(reset.values())
    reset = {k: v / total for k, v in reset.items()}
    got = {r.node: r.reset for r in run(spark, "ppr_reset")}
    assert got.keys() == reset.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in reset.items())

    out = defaultdict(list)
    for _, _, a, b in edges:
        out[a].append(b)
    nodes = {*out, *reset, *(b for v in out.values() for b in v)}
    p = {k: reset.get(k, 0.0) for k in nodes}
    for _ in range(20):
        flow = defaultdict(float)
        for a, v in out.items():
            for b in v:
                flow[b] += p[a] / len(v)
        lost = sum(p[k] for k in nodes if k not in out)
        p = {k: 0.5 * reset.get(k, 0.0) + 0.5 * (flow[k] + lost * reset.get(k, 0.0)) for k in nodes}
    got = {r.node: r.score for r in run(spark, "ppr_scores")}
    assert got.keys() == p.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in p.items())


def words(text):
    t = text.strip().lower()
    for _ in range(2):
        t = re.sub(r"([^\W\d_])[^\w\s]([^\W\d_])", r"\1 \2", t)
    kept = (ch for i, ch in enumerate(t) if not (re.match(r"[^\w\s]", ch) and not t[i - 1 : i].isdigit() and not t[i + 1 : i + 2].isdigit()))
    return "".join(kept).split()


def test_metrics_score_whole_texts(spark):
    raw = defaultdict(dict)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        raw[r.conv_id][r.turn] = r.text
    pairs = {(r.case, r.pos): (r.pred, r.gt) for r in E._pairs(spark, SF).collect()}
    for (conv, turn), (pred, gt) in pairs.items():
        later = min(t for t in raw[conv] if t > turn)
        assert pred.startswith(raw[conv][turn]) and gt.startswith(raw[conv][later])
    assert any(len(p) > 300 for p, _ in pairs.values())
    f1, recall, lcs, bag = {}, {}, {}, {}
    for k, (pred, gt) in pairs.items():
        a, b = words(pred), words(gt)
        tp = len({*a} & {*b})
        f1[k], recall[k] = 2 * tp / (len({*a}) + len({*b})), tp / len({*b})
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
        lcs[k] = 2 * row[-1] / (len(a) + len(b))
        bag[k] = sum((Counter(re.findall(r"\w+", pred.lower())) & Counter(re.findall(r"\w+", gt.lower()))).values())
    for name, col, want in (("token_f1", "f1", f1), ("answer_recall", "recall", recall), ("rouge_l", "rouge_l", lcs), ("corpus_bag_overlap", "overlap", bag)):
        got = {(r.case, r.pos): r[col] for r in run(spark, name)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items()), name
    one = spark.createDataFrame([(*k, *v) for k, v in pairs.items()], "case long, pos long, pred string, gt string")
    for name, col, f in (("negation_consistency", "score", M.negation_consistency), ("numeric_fidelity", "fidelity", M.numeric_fidelity), ("bleu4", "bleu", M.bleu4)):
        x = f(F.col("pred"), F.col("gt"))
        want = {(r.case, r.pos): r.x for r in one.select("case", "pos", F.round(x["score"] if col == "score" else x, 6).alias("x")).collect()}
        assert {(r.case, r.pos): r[col] for r in run(spark, name)} == want, name
    assert sum(r.n for r in run(spark, "baseline_report")) == len(pairs)
    n = [(r.score, r.n) for r in run(spark, "negation_consistency")]
    (m,) = run(spark, "weighted_negation_mean")
    assert m.n == sum(k for _, k in n) and m["mean"] == pytest.approx(sum(s * k for s, k in n) / m.n, abs=1e-6)


def test_chains_hold_every_event(spark):
    chains = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id):
        i = r.event_id
        chains[r.user_id * 100 + i // 2500].append((r.event_type, f"value {i % 4}", f"value {i % 3 if i % 5 == 0 else i % 4}"))
    f1, valid, accuracy = {}, {}, {}
    for k, v in chains.items():
        a, b = {(t, x) for t, x, _ in v}, {(t, y) for t, _, y in v}
        f1[k] = 2 * len(a & b) / (len(a) + len(b))
        valid[k] = k % 2 == 0 or all(x == y for _, x, y in v)
        last = {t: x == y for t, x, y in v}
        accuracy[k] = sum(last.values()) / len(last)
    for name, col, want in (("edge_f1", "f1", f1), ("path_validity", "valid", valid), ("node_accuracy", "accuracy", accuracy)):
        got = {r.case: r[col] for r in run(spark, name)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items()), name


def test_coordinates_come_from_all_orders(spark, monkeypatch):
    from marlstone.plans import retrieval_vectors

    # keys beyond the old bound of 20000
    orders = spark.createDataFrame([(i * 100, i) for i in range(1, 1001)], "o_orderkey long, o_custkey long")
    monkeypatch.setattr(retrieval_vectors, "table", lambda *a: orders)
    n = Counter(i % 7 for i in range(1, 1001))
    assert {r.slide_id: r.n for r in retrieval_vectors.encode_policy(spark, SF).collect()} == n
    got = retrieval_vectors.stratified_sample(spark, SF).collect()
    assert Counter(r.slide_id for r in got) == {k: 100 for k in n} and max(r.ord for r in got) > 20000


def test_records_hold_whole_tables_and_texts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    hits = {r.query_id: r.context for r in run(spark, "format_hits")}
    assert hits.keys() == {i // 30 for i in docs}
    for q, got in hits.items():
        assert got == "\n---\n".join(f"[{i % 30}] {docs[i].source}\n{docs[i].text}" for i in sorted(docs) if i // 30 == q)
    keys = {r.doc_id: r.key for r in run(spark, "canonical_key")}
    assert keys == {i: re.sub(r"[^a-z0-9_]", "", re.sub(r"[ \t\n\x0b\f\r\-]+", "_", d.text.strip(" ").lower())) for i, d in docs.items()}
    answers = {r.doc_id: r.answer for r in run(spark, "qa_pairs") if r.node_id == "naive_oneshot"}
    assert answers == {i: docs[i].text.strip() for i in answers} and len(answers) >= len(docs) // 4
    vectors = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {r["rank"] for r in run(spark, "flatten_evidence")} == set(vectors)
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert {r.s_suppkey: r.c_name for r in run(spark, "specimen_key_join")} == {r.s_suppkey: names.get(r.s_suppkey) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    talk = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in run(spark, "next_question_lead"):
        later = [t for k, t in talk if k == r.case and t > r.pos]
        assert not r.next_question or r.next_question in {talk[r.case, t] for t in later}
    assert max(len(r.prompt) for r in run(spark, "step_prompts")) > 300


def test_inner_loop_runs_over_every_event(spark):
    events = sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id)
    loops = defaultdict(list)
    for r in events:
        loops[r.user_id, r.event_type].append(r)
    want = set()
    for (case, node), rows in loops.items():
        seen = set()
        for i, r in enumerate(rows[:3]):
            want.add((case, node, i, r.value > 15, ",".join(map(str, sorted(seen)))))
            seen |= {r.event_id % 9, r.event_id % 5}
            if r.value > 15:
                break
    assert {(r.case, r.node_id, r.iter, r.sufficient, r.excluded) for r in run(spark, "inner_loop")} == want
