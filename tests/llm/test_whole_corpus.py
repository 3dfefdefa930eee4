"""The pipeline and mixing on inputs that the given tables do not have."""

import random

import corpus_pipeline
from marlstone.llm import mixing


def text(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (5, text(2)), (2, text(3)), (2, text(4)), (9, text(4)), (3, text(5)), (None, text(5)), (None, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, text(1)), (1, text(2)), (2, text(3)), (2, text(4)), (3, text(5)), (None, text(6))], key=repr)


def test_every_copy_has_a_shard_and_a_place_in_it(spark):
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (5 + i % 7))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, carry=False).collect()
    assert all(len(r.positions) == len(r.shards) == r.copies for r in got) and any(r.copies > 1 for r in got)
    order = sorted((s, p, r.doc_id) for r in got for s, p in zip(r.shards, r.positions))
    assert len({x[:2] for x in order}) == len(order)
    again = sorted((s, p, r.doc_id) for r in mixing.mix(df.repartition(5)).collect() for s, p in zip(r.shards, r.positions))
    assert again == order
    first = [d for s, _, d in order if s == order[0][0]]
    assert len(first) > 5 and first != sorted(first)


def test_equal_rows_are_decided_one_by_one(spark):
    rows = [(1, "w " * 60, "a", "en")] * 1000 + [(2, "v " * 1200, "b", "en")] * 20 + [(2, "v " * 1200, "b", "de")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    target = {"a": 108_000 * 5 / 7, "b": 108_000 * 2 / 7}
    target["a"], target["b"] = min(target["a"], 180_000), min(target["b"], 144_000)
    for carry in (False, True):
        got = mixing.mix(df, carry=carry).collect()
        assert len(got) == 1040 and all(r.taken == r.size * r.copies <= 3 * r.size for r in got)
        for s, size in (("a", 60), ("b", 1200)):
            assert 0 <= target[s] - sum(r.taken for r in got if r.source == s) < size
        if carry:
            assert sum(r.lang == "de" for r in got) == 20
    many = spark.createDataFrame([(1, 5), (1, 6)], "doc_id long, _mix_key long").limit(1)
    numbers = mixing._numbered(spark.createDataFrame([(1, 5, k) for k in range(5000)] + [(2, 5, 0)], "doc_id long, _mix_key long, k int").repartition(3), many).collect()
    assert sorted(r._row for r in numbers) == list(range(1, 5001))
