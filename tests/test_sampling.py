import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.operators import sampling


def md5_order(ids, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 1000])
def test_exact_split(spark, n):
    rows = sampling.exact_split(spark.range(n), ["id"]).collect()
    test = {r["id"] for r in rows if r["split"] == "test"}
    assert len(rows) == n
    assert test == set(md5_order(range(n))[: int(0.2 * n)])


def test_holdout_larger_than_table(spark):
    rows = sampling.holdout(spark.range(10), ["id"], rows=50).collect()
    assert {r["split"] for r in rows} == {"cv"}


def test_sample_rounds_half_to_even(spark):
    for n, k in ((1250, 12), (1350, 14), (49, 0), (51, 1)):
        assert sampling.sample_share(spark.range(n), ["id"]).count() == k


def test_first_rows_of_large_table(spark):
    got = {r["id"] for r in sampling.first_rows(spark.range(20000), 777, ["id"]).collect()}
    assert got == set(md5_order(range(20000))[:777])


def test_seed_changes_the_sample(spark):
    one = {r["id"] for r in sampling.first_rows(spark.range(1000), 50, ["id"], seed=1).collect()}
    two = {r["id"] for r in sampling.first_rows(spark.range(1000), 50, ["id"], seed=2).collect()}
    assert one != two


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(copies=st.lists(st.integers(1, 60), min_size=1, max_size=6), k=st.integers(0, 120))
def test_copies_are_split_exactly(spark, copies, k):
    rows = [(i, "x") for i, c in enumerate(copies) for _ in range(c)]
    df = spark.createDataFrame(rows, "id int, v string")
    marked = sampling.mark_first(df, lambda n: k)
    assert marked.where("taken").count() == min(k, len(rows))
    assert marked.drop("taken").exceptAll(df).count() == 0
    assert marked.count() == len(rows)


def test_copies_fan_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_BLOCK", 7)
    df = spark.range(100).select(F.lit(1).alias("a"))
    marked = sampling.mark_first(df, lambda n: 33)
    assert (marked.count(), marked.where("taken").count()) == (100, 33)


def test_key_ties_fall_back_to_all_columns(spark):
    df = spark.range(50).select(F.lit("same").alias("k"), "id")
    marked = sampling.mark_first(df, lambda n: 20, ["k"])
    assert marked.where("taken").select("id").distinct().count() == 20
    assert marked.select("id").distinct().count() == 50


def test_among_ranks_only_those_rows(spark):
    df = spark.range(100)
    marked = sampling.mark_first(df, lambda n: 10, ["id"], among=F.col("id") % 2 == 0)
    taken = {r["id"] for r in marked.where("taken").collect()}
    assert taken == set(md5_order(range(0, 100, 2))[:10])
    assert marked.count() == 100


def test_flagging_shuffles_nothing(spark):
    marked = sampling.exact_split(spark.range(1000), ["id"])
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_classifier_splits(spark):
    from corpuslab.plans.training import classifier_splits

    examples = spark.range(100).select("id", F.col("id").cast("string").alias("text"), F.lit(1).alias("label"))
    splits = classifier_splits(examples.where("id < 80"), examples.where("id >= 80"), 15, ["id"])
    assert {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()} == {
        "train": 65, "cv": 15, "test": 20,
    }
    assert splits.select("text").distinct().count() == 100
