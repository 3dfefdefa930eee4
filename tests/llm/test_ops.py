"""The corpus operators against brute force on small fixtures: nulls, empty and odd texts, ties, repeats, empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate as D
from marlstone.llm import elias_fano, html_extract, language_id, mixing, ngram_join, quality_classifier, quality_rules, repeats, token_files
from marlstone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en" if i % 3 else None, (sources or {}).get(i, f"s{i % 3}"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(80)]
    say = lambda k: " ".join(rng.choice(words, k))
    out = [say(rng.integers(1, 120)) for _ in range(n)]
    base = say(150)
    out += [base, base, base + " end", "x " + base, base.replace(words[3], "zz"), None, "", " \n\t ", "one", "a b c d", "a b c d", "the the the the the the", "line\nline\nline\nother\nline", "Ünïcödé " * 30, "a" * 5000 + " " + "b" * 5000]
    mid = out[0] + base[:260] + out[1]
    return out + [mid]


# -- rules -------------------------------------------------------------------


def test_ledger_equals_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(frame(spark, texts).withColumn("failed", F.lit("clash")))).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        assert g.text == t and g.kept == (g.failed == 0) and bool(g.failed & 3) == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_policies_and_ablation_read_only_the_ledger(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (5,), (4,)], "failed int")
    assert [r.kept for r in quality_rules.apply_policy(book, "lenient").collect()] == [True, False, False, False, True]
    a = {r.rule: tuple(r)[1:] for r in ((x.rule, x.n_fail, x.n_only, x.n_regained) for x in quality_rules.ablation(book).collect()) for r in [collections.namedtuple("R", "rule a b c")(*r)]}
    assert a["few_words"] == (3, 2, 2) and a["symbols"] == (2, 1, 1) and a["unbroken"] == (0, 0, 0)


# -- near duplicates ---------------------------------------------------------


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def test_similar_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = corpus(1)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() * 8
    for k in range(90):  # one group of near copies, larger than a tile in this test
        w = [f"{x}{j}" for j, x in enumerate(base)]
        w[rng.integers(80)] = f"new{k}"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in ngram_join.similar(frame(spark, texts), tile=32).collect()}
    s = sets(texts)
    cls = {i: min((j for j in range(len(s)) if s[j] == s[i] and s[i]), default=i) for i in range(len(s))}
    reps = sorted({c for i, c in cls.items() if s[i]})
    links = {c: sum(d != c and len(s[c] & s[d]) >= 0.8 * len(s[c] | s[d]) for d in reps) for c in reps}
    for i in range(len(s)):
        assert (got[i].class_id, got[i].n_links) == (cls[i], links.get(cls[i], 0)), i
        assert got[i].n_copies == (sum(x == s[i] for x in s) if s[i] else 1)


def test_similar_of_nothing(spark):
    assert ngram_join.similar(frame(spark, [])).collect() == []


def test_bands_reach_the_recall():
    b, r = ngram_join.plan_bands(0.8, 0.999, 256)
    assert b * r <= 256 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_components_of_a_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 120)} == {100}


def test_components_through_hot_nodes(spark):
    rng = np.random.default_rng(4)
    e = [(5000 - i, 5000) for i in range(1, 1200)] + [(9000, 9000 + i) for i in range(1, 700)] + [(4999, 9001)]
    e += [(int(a), int(b)) for a, b in rng.integers(20000, 20400, (150, 2))]
    root = {x: x for pair in e for x in pair}
    for _ in range(400):
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in (a, b) and a != b for a, b in e)}
    assert {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long").repartition(5)).collect()} == want


# -- decontamination ---------------------------------------------------------


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    index = D.Index([(i, " ".join(rng.choice(words, rng.integers(8, 25)))) for i in range(50)], threshold=0.4)
    for _ in range(60):
        present = np.unique(rng.integers(0, len(index.bound), rng.integers(1, 45)))
        full = np.zeros(len(index.ids))
        for t in present:
            full[index.items[t]] += index.weights[t]
        assert dict(index.wand(present)) == pytest.approx({i: full[i] for i in np.flatnonzero(full >= 0.4 - 1e-9)})


def test_planted_items_are_found_and_removed(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    say = lambda k: " ".join(rng.choice(words, k))
    items = [(i, f"{say(25)}. {say(8)}.") for i in range(20)] + [(20, None), (21, ""), (22, "too short")]
    docs = [say(300) for _ in range(30)] + [f"{say(137)} {items[k][1].upper()} {say(90)}" for k in range(5)] + [None, "", items[3][1]]
    ib = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.scan(frame(spark, docs), ib).collect()}
    assert got == {(30 + k, k) for k in range(5)} | {(37, 3)}
    assert {r.doc_id for r in D.remove(frame(spark, docs), ib).collect()} == {*range(30), 35, 36}
    many = {(r.doc_id, r.item_id) for r in _grouped(frame(spark, docs), ib)}
    assert many == got


def _grouped(docs, items):
    """The same, with an index that is split."""
    out = []
    for index in D.build(items, most=1500):
        for r in docs.collect():
            out += [collections.namedtuple("Hit", "doc_id item_id")(r.doc_id, index.ids[k]) for _, k, *_ in D._found(index, __import__("pyarrow").array([(r.text or "").lower()]))]
    return out


# -- pages -------------------------------------------------------------------


def test_marginals_equal_enumeration():
    pages = [html_extract.parse(s) for s in ("<div><p>a b</p><nav>c</nav></div>", "<p>x<div>y</div>")]
    forest = html_extract.Forest(pages)
    rng = np.random.default_rng(0)
    u, pair = rng.normal(size=html_extract.WIDTH), rng.normal(size=(3, 2, 2))
    p, _ = forest.marginals(u, pair)
    for page, a, b in zip(pages, forest.start, forest.start[1:], strict=False):
        n = b - a
        total, hit = 0.0, np.zeros(n)
        rel = html_extract._relation(page)
        for bits in range(2**n):
            s = [(bits >> i) & 1 for i in range(n)]
            w = math.exp(sum(u[list(page.feats[i])].sum() * s[i] for i in range(n)) + sum(pair[rel[i], s[page.parent[i]], s[i]] for i in range(n) if page.parent[i] >= 0))
            total += w
            hit += w * np.array(s)
        assert p[a:b] == pytest.approx(hit / total)


def test_extraction_of_unseen_layouts_and_broken_pages(spark):
    model = html_extract.train()
    right = total = 0
    for s in html_extract.labelled_pages(60, seed=123):
        page = html_extract.parse(s)
        want = "\n".join(t.replace("\x01", "") for t in page.texts if t is not None and "\x01" in t)
        right += model.texts([s.replace("\x01", "")])[0] == want
        total += 1
    assert right / total > 0.95
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<html><body><nav><a href=x>m</a></nav><article><h1>T</h1><p>One &amp; two\n three.<br>Four.<p>Fi<b>v</b>e.</article><footer>&copy; me</footer>"), (4, "u", "<article><p>cut &am"), (5, None, "<script>never ends")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[5] == ("", 0) and got[3] == ("T\nOne & two three.\nFour.\nFive.", 30) and got[4][0] == "cut &am"


# -- repeats -----------------------------------------------------------------


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot,batches", [(20_000, 2), (1, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, batches):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(4, 30)
    rng = np.random.default_rng(8)
    common = texts[30] or ""
    texts += [f"{k} {texts[k] or ''} {common[: 210 + 7 * k]} {rng.integers(1 << 40)}" for k in range(12)]
    texts += ["ab" * 150, texts[2] * 3 if texts[2] else "", "q" * 199, "q" * 200, "r" * 201]
    got = {r.doc_id: r for r in repeats.digest(frame(spark, texts), batches=batches).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i


def test_new_batches_are_scanned_against_levels(spark):
    a = frame(spark, ["x" * 50 + "y" * 300, "only here " * 40])
    family = repeats.SuffixFamily()
    for _ in range(3):
        family.add(a)
    assert [level is not None for level in family.levels] == [True, True]
    assert family.scan(a).where("whole").count() > 0


# -- mixing ------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        level = rest / max(sum(w[s] for s in names if s not in full), 1e-12)
        more = {s for s in names if s not in full and level * w[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= more


def test_mixing_reaches_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(rng.integers(1, 40))) + f" {i}" for i in range(400)] + [None, ""]
    src = {i: ["a", "b", None, "hot", "hot", "hot", "tiny"][i % 7] if i % 50 else "tiny" for i in range(402)}
    df = frame(spark, texts, src)
    got = mixing.mix(df, carry=False).collect()
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[src[i]] += len(WORD.findall(t or ""))
    want, taken = water(sizes), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken == r.size * r.copies <= 3 * r.size and len(r.shards) == r.copies
        taken[r.source] += r.taken
    assert len(got) == 402
    for s, t in want.items():
        assert abs(taken[s] - t) <= 41
    again = mixing.mix(df.repartition(7), carry=True).collect()
    assert sorted((r.doc_id, r.taken, tuple(r.shards)) for r in again) == sorted((r.doc_id, r.taken, tuple(r.shards)) for r in got)
    assert {r.text for r in again} == set(texts)


def test_extra_columns_with_clashing_names_are_harmless(spark):
    names = ("n", "block", "size", "target", "key", "bands", "rid", "marks", "held_out", "score", "window", "_row", "failed", "n_words", "part", "kept", "c1")
    df = frame(spark, ["a b c " * 30, "a b c " * 30, None]).select("*", *[F.lit("clash").alias(n) for n in names])
    ids = [0, 1, 2]
    for out in (mixing.mix(df), mixing.mix(df, carry=False), quality_rules.apply_policy(quality_rules.ledger(df)), ngram_join.similar(df), repeats.digest(df), language_id.predict(df, language_id.BiGRU(["x"])), quality_classifier.score(df, quality_classifier.Ranker(np.zeros((0, quality_classifier.WIDTH)), np.zeros(0)))):
        assert sorted(r.doc_id for r in out.collect()) == ids


def test_splits_keep_exact_quotas(spark):
    q = spark.createDataFrame([(1, 13), (2, 0), (3, 40)], "sid int, n long")
    rows = mixing.split_tree(q, 3, 5).collect()
    by = collections.Counter()
    per = collections.Counter()
    for r in rows:
        by[r.sid] += r.quota
        per[r.shard] += r.quota
    assert (by[1], by[2], by[3]) == (13, 0, 40) and set(per.values()) <= {6, 7} and len(per) == 8


def test_mixing_of_nothing(spark):
    assert mixing.mix(frame(spark, []), carry=False).collect() == []


# -- token files -------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(1000)), sorted(np.random.default_rng(0).integers(0, 10**9, 3000).tolist())])
def test_elias_fano_round_trip(values):
    e = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert e.slice(0, len(values)).tolist() == values
    for i in range(0, len(values), 97):
        assert e.select(i) == values[i] and e.slice(i, i + 300).tolist() == values[i : i + 300]
    if len(values) > 2000:
        assert len(e.to_bytes()) < 8 * len(values) / 2


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_vocabulary())
    odd = ["two  spaces", " lead", "trail ", "\nnew\n", "tab\tbed", "it's we'll 'quoted'", "a b", "<|endoftext|> x", "日本語 テキスト 😀", "x" * 3000, "1 22 333", "a\n\nb", "\r\n"]
    texts = corpus(2, 20) + odd
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
    got = token_files.read(token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), token_files.new_folder(spark))).collect()
    at = 0
    by = {r.doc_id: r for r in got}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (by[i].start, by[i].n_tokens, by[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    assert len(got) == len(rows)


# -- learned operators -------------------------------------------------------


def test_gru_gradients():
    rng = np.random.default_rng(0)
    m = language_id.BiGRU(["a", "b"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    seq, y = rng.integers(0, 256, (6, 4)), np.array([0, 1, 1, 0])
    _, g = m.loss(seq, y)
    for k in ("u", "c", "v", "b"):
        flat = m.p[k].ravel()
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = m.loss(seq, y)[0]
            flat[i] = old - 1e-3
            down = m.loss(seq, y)[0]
            flat[i] = old
            assert g[k].ravel()[i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_language_labels_and_unknown(spark):
    rng = np.random.default_rng(0)
    text = lambda abc: " ".join("".join(rng.choice(list(abc), 5)) for _ in range(60))
    rows = [(i, text("abcde") if i % 2 else text("uvwéz"), "xx" if i % 2 else "yy") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    extra = [(1000, None, None), (1001, "", None), (1002, "123 ... 7", None), (1003, "—", None), (1004, text("abcde") * 30, None)]
    got = {r.doc_id: r for r in language_id.predict(df.union(spark.createDataFrame(extra, df.schema)), model).collect()}
    assert sum(got[i].lang_pred == r for i, _, r in rows if got[i].held_out) / sum(got[i].held_out for i, _, _ in rows) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in range(1000, 1004)) and got[1004].lang_pred == "xx"
    assert language_id.predict(df.limit(0), model).collect() == [] and got[1].held_out == (zlib.crc32(b"1") % 3 == 1)


def test_quality_ranks_held_out_texts(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words, 80)) + "."
    bad = lambda: " | ".join(rng.choice(words, 80)) + "##"
    rows = [(i, good() if i % 4 else bad(), 1 if i % 4 else 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()}
    held = [(got[i].score, got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert all(p == q and (s >= 0.3) == bool(p) for s, p, q in held) and 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert quality_classifier.score(docs, quality_classifier.train(docs, labels.limit(0))).first().score == 0.5


# -- pipeline ----------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijk"), rng.integers(2, 8))) for _ in range(2000)]
    say = lambda k: " ".join(rng.choice(words, k))
    item = f"{say(20)}. {say(8)}."
    texts = [say(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", f"{say(60)} {item} {say(20)}", "short", None, "the " * 100]
    lost = say(70)  # documents without an id are compared too, and one of them stays
    docs = frame(spark, texts).union(spark.createDataFrame([(None, lost, None, None, None)] * 2 + [(None, texts[2], "en", "s", 1)], SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs
    kept = []
    for name, step in P.STAGES:
        out = step(spark, out, str(tmp_path)).cache()
        kept.append((name, {r.doc_id for r in out.collect()}, out.count(), out.columns))
    assert kept[0][1] == {*range(63), None} and kept[1][1] == {*range(60), 62, None} and kept[2][1] == {*range(60), None}
    assert [n for _, _, n, _ in kept[:3]] == [66, 62, 61]
    assert all(c == list(P.COLUMNS) for _, _, _, c in kept[:4]) and kept[3][2] == kept[4][2]
    got = P.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in out.collect())
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
