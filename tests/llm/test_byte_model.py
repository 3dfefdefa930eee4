import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import byte_model as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def brute(rows):
    """CTW by its definition, on dicts of nodes."""
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    nodes = {}
    for t in train:
        s = bytes(M.DEPTH) + lower(t) + b"\0"
        for i in range(M.DEPTH, len(s)):
            for d in range(M.DEPTH + 1):
                for j in range(8):
                    key = (s[i - d : i], s[i] >> (8 - j), j)
                    nodes.setdefault(key, [0, 0])[(s[i] >> (7 - j)) & 1] += 1
    kids = {}
    for c, q, j in nodes:
        if c:
            kids.setdefault((c[1:], q, j), []).append((c, q, j))
    memo = {}

    def own(k):
        a, b = nodes[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def whole(k):
        if k not in memo:
            memo[k] = own(k) if len(k[0]) == M.DEPTH else np.logaddexp(math.log(0.5) + own(k), math.log(0.5) + sum(whole(x) for x in kids[k]))
        return memo[k]

    def p(ctx, q, j, bit):
        out = None
        for d in range(M.DEPTH, -1, -1):
            k = (ctx[len(ctx) - d :], q, j)
            if k not in nodes:
                continue
            kt = (nodes[k][bit] + 0.5) / (sum(nodes[k]) + 1)
            w = math.exp(math.log(0.5) + own(k) - whole(k))
            out = kt if out is None else w * kt + (1 - w) * out
        return 0.5 if out is None else out

    count = Counter()
    for t in train:
        count.update(WORD.findall(lower(t).decode()))
    n, v = sum(count.values()) + len(train), len(count) + (len(train) > 0)
    result = {}
    for i, t in rows:
        s = bytes(M.DEPTH) + lower(t) + b"\0"
        log = sum(math.log10(p(s[k - M.DEPTH : k], s[k] >> (8 - j), j, (s[k] >> (7 - j)) & 1)) for k in range(M.DEPTH, len(s)) for j in range(8))
        w = WORD.findall(lower(t).decode())
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        result[i] = (len(w) + 1, sum(count[x] > 0 for x in w) + (len(train) > 0), n, base, log)
    return result


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_matches_context_tree_weighting_by_definition(spark, block):
    rng = np.random.default_rng(0)
    words = ["the", "cat", "Éàü", "sat", "on", "mat", "x1"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(40)] + [(40, ""), (41, None), (42, " \n "), (43, "zzz qqq"), (44, "The cat\nsat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in M.score(df, block_bytes=block).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (n, k, t, base, log) in want.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, k, t)
        assert g.base_score == pytest.approx(base, abs=1e-6) and g.score == pytest.approx(log, rel=1e-4, abs=1e-4)
        assert g.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_empty_table(spark):
    assert M.score(spark.createDataFrame([], "doc_id long, text string, block string")).collect() == []


def test_packed_lists_come_back():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64))
    assert (M._unpack(M._pack(v), 1000) == v).all() and (M._unpack(M._pack(v[::-1], False), 1000, False) == v[::-1]).all()
    assert (M._unpack(M._pack(np.zeros(5, np.uint64), False), 5, False) == 0).all()
