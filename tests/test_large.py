"""What larger tables bring: cases cut into frames, tables of several files."""

import datetime
from collections import defaultdict
from pathlib import Path

import pytest

from marlstone.operators import graph as G
from marlstone.plans import registry
from marlstone.sources.scratch import shared


def run(spark, name, sf):
    return registry.queries()[name](spark, str(sf)).collect()


@pytest.mark.parametrize("files", [1, 3])
def test_memory_of_cases_in_many_frames_and_files(spark, tmp_path, files):
    rows = [(i, datetime.datetime(2024, 1, 1), i % 2, "view" if i % 5 else None) for i in range(90)]
    mixed = spark.createDataFrame([rows[i * 37 % 90] for i in range(90)], "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1)
    out = str(tmp_path / "events.parquet")
    if files == 1:
        mixed.toPandas().to_parquet(out, coerce_timestamps="us")
    else:
        mixed.repartition(files).write.parquet(out)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.case, r.pos): r.context for r in run(spark, "episodic_memory", tmp_path)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    said, want = defaultdict(list), {}
    for i, _, user, kind in rows:
        want[user, i] = "; ".join(said[user])
        said[user] += [f"{kind}=a{i % 3}"] if kind else []
    assert got == want


def test_evidence_files_hold_a_slides_paths_once(spark, tmp_path):
    spark.range(200_000).where("id % 100 <> 59").selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(60).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(9_600).selectExpr("id AS event_id", "id div 16 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    out = tmp_path / "out"
    registry.queries()["visual_evidence"](spark, str(tmp_path)).write.parquet(str(out))
    got = spark.read.parquet(str(out)).where("n_paths > 3").selectExpr("count(*)", "count(distinct paths)", "sum(length(paths))").first()
    assert tuple(got) == (1180, 59, 1180 * (2000 * 12 - 1))  # 28 MB
    assert spark.read.parquet(str(out)).where("slide_id = 59 AND n_paths + length(paths) > 0").isEmpty()
    assert sum(f.stat().st_size for f in out.iterdir()) < 3_000_000


def test_pagerank_writes_edges_once_as_numbers(spark, monkeypatch):
    edges = spark.range(60_000).selectExpr("concat('source ', id % 4999) AS src", "concat('end ', id * id % 5003) AS dst")
    reset = spark.createDataFrame([("source 1", 0.25), ("source 2", 0.75)], "node string, reset double")
    want = {r.node: r.score for r in G.pagerank(edges, reset, rounds=2).collect()}
    size = lambda: sum(f.stat().st_size for f in Path(shared(spark).removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    monkeypatch.setattr(G, "HELD_EDGES", 7_000, raising=False)
    monkeypatch.setattr(G, "BLOCK_EDGES", 20_000, raising=False)
    got = {r.node: r.score for r in G.pagerank(edges, reset, rounds=2, small_edges=0).collect()}
    assert size() - before < 1_500_000
    assert got == pytest.approx(want)
