"""Lexical and hybrid retrieval: BM25 over a postings table, rank fusion, leak guard, rerank, index fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

K1, B, FUSE = 1.5, 0.75, 60


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf, len) and one row of n and mean length. Terms of a document are counted inside its row, so the
    shuffle carries distinct terms only."""
    w = docs.select(F.col(key).alias("id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    stats = w.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w").cast("double")).alias("mean"))
    post = w.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    return post, stats


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) for distinct query terms; only documents that share a term."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    post, stats = postings(docs)
    # only the queries' terms are kept before documents are counted
    post = post.join(terms.select("term").distinct(), "term", "left_semi")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = terms.join(df, "term").join(post, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return s.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(scores: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "id")))
    return out if k is None else out.where(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], c: int = FUSE) -> DataFrame:
    """Weighted reciprocal ranks of ranked lists: a tagged union, added up (the same as full outer joins)."""
    parts = [df.select("query_id", "id", (F.lit(w) / (c + F.col("rank"))).alias("p")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out.groupBy("query_id", "id").agg(F.round(F.sum("p"), 9).alias("score")))


def leaks(exclude: Column, *keys: Column) -> Column:
    """True if a token of ``exclude`` is one of the keys' tokens; tokens stand between commas or semicolons."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.arrays_overlap(F.flatten(F.array(*[split(k) for k in keys])), split(exclude))


def leaks_chain(doc_id: Column, case_key: Column, exclude: Column) -> Column:
    """The graph memory's guard: an id is a token or one of its chains, or the key itself or its prefix."""
    parts = F.filter(F.transform(F.split(exclude, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.exists(parts, lambda t: (doc_id == t) | doc_id.startswith(F.concat(t, F.lit("_chain_")))) | (case_key == exclude) | doc_id.startswith(exclude)


def depth_k(zoom: Column, k: Column) -> Column:
    return F.when(zoom == "5x", F.greatest(F.lit(1), F.floor(k / 2))).when(zoom.isin("20x", "40x"), F.least(k * 2, F.lit(20))).otherwise(k).cast("int")


def fetch_k(k: Column, prefer_reference: Column, excluding: Column) -> Column:
    wide = F.when(prefer_reference, k * 2).otherwise(k)
    return F.when(excluding, F.greatest(k * 2, k + 4, wide)).otherwise(wide)


def rerank(hits: DataFrame, k: Column | int) -> DataFrame:
    """References first, then those of the query's node, else in the old order; cut to k. Needs rank, is_reference,
    node_match and prefer."""
    boost = lambda c: F.when(F.col("prefer"), F.col(c).cast("int")).otherwise(0).desc()
    w = Window.partitionBy("query_id").orderBy(boost("is_reference"), boost("node_match"), "rank")
    return hits.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def fingerprint(docs: DataFrame, settings: dict[str, str] | None = None, key: str = "id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """One row: SHA-256 of the ordered document hashes and the settings. Hashes are listed in buckets by id, then the
    buckets' hashes, so no task holds all documents."""
    h = docs.select(F.pmod(F.col(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    one = h.groupBy("bucket").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: F.concat_ws(":", s["k"].cast("string"), s["h"])), "|"), 256).alias("h"))
    tail = ";".join(f"{k}={v}" for k, v in sorted((settings or {}).items()))
    return one.agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda s: s["h"]), "|"), F.lit("#" + tail)), 256).alias("fingerprint"), F.count(F.lit(1)).alias("buckets"))


def require_same(stored: str | None, now: str, force: bool = False) -> bool:
    """True if the index must be rebuilt; an index of another corpus is refused unless forced."""
    if force or stored is None:
        return True
    if stored != now:
        raise ValueError("the index was built from another corpus; rebuild it with force")
    return False
