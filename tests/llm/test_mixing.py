import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def plain_targets(sizes: dict) -> dict:
    """Shares by weight, capped at twice the size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2.0 * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def test_awkward_documents(awkward):
    rows = mixing.allocate(mixing.sized(awkward)).collect()
    assert len(rows) == awkward.count()
    sizes: dict = {}
    for r in rows:
        n = len(re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode()))
        assert r["_mix_size"] == n
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    goal = plain_targets(sizes)
    taken: dict = {}
    for r in rows:
        assert r["_mix_source_size"] == sizes[r["source"]]
        assert r["_mix_target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["_mix_taken"] <= 2 * r["_mix_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["_mix_taken"]
    assert all(abs(taken[s] - goal[s]) < 1 for s in goal)


def test_whole_epochs_come_first_and_reruns_agree(awkward):
    one, two = (sorted((str(r["doc_id"]), r["_mix_tie"], r["_mix_taken"]) for r in mixing.allocate(mixing.sized(awkward.repartition(n))).collect()) for n in (2, 7))
    assert one == two
    for r in mixing.allocate(mixing.sized(awkward)).collect():
        if r["_mix_source_size"]:
            assert r["_mix_taken"] >= int(r["_mix_target"] // r["_mix_source_size"]) * r["_mix_size"]


def test_mixed_rows_hold_the_words_that_are_taken(awkward, empty):
    plan = mixing.allocate(mixing.sized(awkward)).agg(F.sum("_mix_taken")).first()[0]
    made = mixing.mix(awkward)
    assert made.columns == awkward.columns
    rows = made.collect()
    assert sum(len(re.findall(rb"[^\x20\x09-\x0D]+", r["text"].encode())) for r in rows) == plan
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_heavier_documents_come_earlier(spark):
    rows = [(i, "w " * 10 if i % 2 else "1 " * 10, "s") for i in range(400)] + [(1000 + i, "x " * 50, "t") for i in range(200)]
    found = mixing.allocate(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")), share=0.15)
    share = found.where("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg((F.col("_mix_taken") > 0).cast("int")).alias("p")).collect()
    by = {r["odd"]: r["p"] for r in share}
    assert by[1] > by[0]


def test_clashing_and_awkward_column_names(spark):
    rows = [(i, f"w{i} " * (i % 7 + 1), "ab"[i % 2], 111, 5, "x", "y", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_size int, `a.b` int, c0 string, _mix_times string, n_chars int")
    made = mixing.mix(df)
    assert made.columns == df.columns
    by_id = {r[0]: r for r in rows}
    found = made.collect()
    assert found and all(tuple(r)[3:7] == by_id[r["doc_id"]][3:7] and by_id[r["doc_id"]][1].startswith(r["text"]) for r in found)


def test_budgets_that_end_within_repeated_rows(spark):
    """Copies of one row, in id and text: whole ones, then a cut one, whatever their other columns."""
    rows = [(1, "a b c d e", "s", i) for i in range(9)] + [(i, "x " * 30, "t", 0) for i in range(2, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(3)
    for share in (0.02, 0.03, 0.05, 1.5):
        plan = {(r["source"], r["words"]) for r in mixing.allocate(mixing.sized(df), share=share).groupBy("source").agg(F.sum("_mix_taken").alias("words")).collect()}
        made = mixing.mix(df, share=share).withColumn("n", mixing.size_of(F.col("text"))).groupBy("source").agg(F.sum("n").alias("words")).collect()
        assert {(r["source"], r["words"]) for r in made} == {p for p in plan if p[1]}


def test_slices_change_nothing(awkward, monkeypatch):
    want = sorted((str(r["doc_id"]), r["_mix_tie"], r["_mix_taken"]) for r in mixing.allocate(mixing.sized(awkward)).collect())
    for slices in (1, 7, 100_000):
        assert want == sorted((str(r["doc_id"]), r["_mix_tie"], r["_mix_taken"]) for r in mixing.allocate(mixing.sized(awkward, slices)).collect())
    assert mixing.slices_for(10) == mixing.KEY_BUCKETS and mixing.slices_for(10**9) == 10**9 // mixing.SLICE_ROWS
