"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of five-word shingle fingerprints, a signature and ``bands`` band hashes; bands and rows
   are chosen for a target recall at the threshold (``plan_bands``).
2. Rows with equal sets form a class with one representative, so copies never meet each other again. Sets are told
   apart by two sums over them, one of shingle fingerprints and one of others made with independent keys.
3. Representatives are shuffled on (band, hash); a bucket hands on a star of edges, never its pairs. Components of
   those edges are what a representative could be linked to.
4. Components are dealt by hash in chunks of about ``TILE`` members, and pairs of chunks are tiles; a tile gets its
   members' texts, rebuilds the full sets, and verifies every pair of it that shares a band, in memory. It returns
   counts of links and a spanning forest of them, linear in its members. A component of any size is many tiles, so no
   group meets in one task. Two texts are linked if they share a band and their full sets reach the threshold, whatever
   component they are in; ``RECALL`` is the chance that a pair of just the threshold shares one.

Defined results: words are runs of non-white-space, compared as they stand; null, empty or blank texts have no
shingles: each is a class of its own with no links; a text of fewer than five words has one shingle, all its words;
identical rows share a class; ties and order do not matter; extra columns are ignored; an empty table gives an empty
result. doc_id names a document: of rows that share an id but not a text the least text is compared; rows without an id
are counted in their class but link to nothing on their own. n_links counts other classes linked to the row's class; class_id and group_id are least doc_ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import flat, mix, portions, range_hashes, small_batches, stage, tidy, words_of
from marlstone.llm.components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.999999
TILE = 256


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose recall at the threshold is reached
    with at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(buf: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, others of independent keys, offsets): the distinct shingles of each row, sorted inside a row."""
    start, end, first = words_of(buf, off)
    w, v = range_hashes(buf, start, end, 11), range_hashes(buf, start, end, 977)
    rows = len(off) - 1
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(rows), made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + first[row]
    h, g = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    have = np.minimum(count, n)[row]
    for k in range(n):
        use = slice(None) if len(have) and have.min() > k else np.flatnonzero(have > k)
        h[use] = mix(h[use] * np.uint64(0x9E3779B97F4A7C15) + w[at[use] + k] + np.uint64(k + 1))
        g[use] += mix(v[at[use] + k] * np.uint64(2 * k + 3))
    order = np.lexsort((h, row))
    h, g, row = h[order], g[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, g, row = h[new], g[new], row[new]
    return h, g, np.searchsorted(row, np.arange(rows + 1))


def signatures(h: np.ndarray, off: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """(texts, bands) band hashes; texts without shingles get zeros."""
    rng = np.random.default_rng(seed)
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, bands), np.uint64)
    if not len(full):
        return out
    x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    at = off[:-1][full]
    a, b = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    y = np.empty_like(x)
    for i in range(bands):
        acc = np.zeros(len(full), np.uint64)
        for j in range(rows):
            k = i * rows + j
            np.multiply(x, a[k], out=y)
            y ^= b[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            acc = mix(acc + np.minimum.reduceat(y, at).astype(np.uint64) + np.uint64(1))
        out[full, i] = acc
    return out


def _sign(batches, bands: int, rows: int):
    for batch in batches:
        buf, off = flat(batch.column(1))
        for i, j in portions(off):
            h, g, so = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            sig = signatures(h, so, bands, rows)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ np.uint64(s)))]) for x, s in ((h, 0x51ED27), (g, 0xA3C59B))]
            c1, c2 = (mix((s[so[1:]] - s[so[:-1]]) + np.diff(so).astype(np.uint64)).view(np.int64) for s in sums)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), pa.array(sig.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(c1), pa.array(c2), pa.array(np.diff(so), pa.int64()), arr], names=["doc_id", "c1", "c2", "n_shingles", "bands"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (least index) of each of n members under edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    while (root[root] != root).any():
        root = root[root]
    return root


def verified_pairs(h: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a, b) of sets have a Jaccard similarity of the threshold or more. The sets' shared
    shingles are numbered; shingles are taken in runs whose membership table stays small."""
    n = len(off) - 1
    size = np.diff(off)
    owner = np.repeat(np.arange(n), size)
    values, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    keep = times[inverse] > 1
    owner, inverse = owner[keep], inverse[keep]
    number = np.cumsum(times > 1) - 1
    inverse = number[inverse]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    total = int(number[-1]) + 1 if len(number) else 0
    both = np.zeros(len(a), np.int64)
    width = 8192
    dense = len(a) > n * 4
    inter = np.zeros((n, n), np.float32) if dense else None
    for lo in range(0, total, width):
        i, j = np.searchsorted(inverse, [lo, lo + width])
        table = np.zeros((n, min(width, total - lo)), np.float32 if dense else bool)
        table[owner[i:j], inverse[i:j] - lo] = 1
        if dense:
            inter += table @ table.T
        else:
            for p in range(0, len(a), 1024):
                both[p : p + 1024] += np.count_nonzero(table[a[p : p + 1024]] & table[b[p : p + 1024]], axis=1)
    if dense:
        both = inter[a, b].astype(np.int64)
    union = size[a] + size[b] - both
    return both >= threshold * union - 1e-9


def _tile(table: pa.Table, threshold: float, bands: int, rows: int) -> pa.Table:
    """One tile: members of two chunks (or one), their links and a spanning forest of the links."""
    ids = table.column("doc_id").to_numpy()
    chunk = table.column("chunk").to_numpy()
    buf, off = flat(table.column("text"))
    h, _, so = shingles(buf, off)
    sig = signatures(h, so, bands, rows)
    n, one = len(ids), chunk.min() == chunk.max()
    left, right = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
    share = np.zeros((len(left), len(right)), bool)
    for k in range(sig.shape[1]):
        share |= sig[left, k][:, None] == sig[right, k][None, :]
    if one and table.column("alone")[0].as_py():
        share = np.triu(share, 1)
    elif one:
        share[:] = False
    x, y = np.nonzero(share)
    a, b = left[x], right[y]
    ok = verified_pairs(h, so, a, b, threshold) if len(a) else np.zeros(0, bool)
    a, b = a[ok], b[ok]
    links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    root = _forest(n, a, b)
    some = links > 0
    return pa.table({"doc_id": pa.array(ids[some], pa.int64()), "root": pa.array(ids[root[some]], pa.int64()), "links": pa.array(links[some], pa.int64())})


def similar(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """A row a row of ``docs``: doc_id, class_id, n_copies, n_links, group_id, n_shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = plan_bands(threshold, recall)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sign(batches):
        yield from tidy(_sign(batches, bands, rows))

    signed = stage(slim.mapInArrow(sign, "doc_id long, c1 long, c2 long, n_shingles long, bands array<long>"), "signed")
    # texts without shingles are like nothing; each row stays alone
    full = signed.where("n_shingles > 0")
    classes = stage(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")), "classes")
    bucket = classes.where(F.col("class_id").isNotNull()).select("class_id", F.posexplode("bands").alias("band", "hash"))
    least = bucket.groupBy("band", "hash").agg(F.min("class_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = bucket.join(least, ["band", "hash"]).where("class_id <> least").select(F.col("class_id").alias("a"), F.col("least").alias("b"))
    comp = stage(components(edges), "candidates")
    # chunks of a component by hash, as many as its counted size asks for; a tile is a pair of chunks
    large = comp.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks")).where("chunks > 1")
    member = comp.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select(F.col("node").alias("doc_id"), "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") == F.col("other")).alias("alone"))
    texts = slim.join(comp.select(F.col("node").alias("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    dealt = tiles.join(texts, "doc_id").select("root", "i", "j", "doc_id", "chunk", "alone", "text")

    def one_tile(table: pa.Table) -> pa.Table:
        return _tile(table, threshold, bands, rows)

    found = stage(dealt.groupBy("root", "i", "j").applyInArrow(one_tile, "doc_id long, root long, links long"), "links")
    groups = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    linked = links.join(groups, links["doc_id"] == groups["node"], "left").select(F.col("doc_id").alias("class_id"), "n_links", F.coalesce("root", "doc_id").alias("group_id"))
    by_class = classes.join(linked, "class_id", "left").select("c1", "c2", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    key = (F.col("s.c1") == F.col("c.c1")) & (F.col("s.c2") == F.col("c.c2")) & (F.col("s.n_shingles") > 0)
    out = signed.drop("bands").alias("s").join(by_class.alias("c"), key, "left")
    return out.select("s.doc_id", F.coalesce("c.class_id", "s.doc_id").alias("class_id"), F.coalesce("c.n_copies", F.lit(1)).alias("n_copies"), F.coalesce("c.n_links", F.lit(0)).alias("n_links"), F.coalesce("c.group_id", "s.doc_id").alias("group_id"), "s.n_shingles")
