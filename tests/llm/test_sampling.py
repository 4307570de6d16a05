"""Samples drawn per label: their size, and that rows are cut off before a shuffle."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.llm import common


def test_rows_of_one_id_give_as_many_as_asked(spark):
    rows = spark.range(100_000).select(F.lit(7).alias("id"), F.lit("x").alias("label"), F.concat(F.lit("text "), "id").alias("text"))
    alike = common.fewest(rows, "label", F.xxhash64("id"), 2000, "id")
    assert alike.columns == rows.columns and alike.count() == 2000
    apart = common.fewest(rows, "label", F.xxhash64("id", "text"), 2000, "text")
    assert apart.count() == 2000 and apart.distinct().count() == 2000


def test_smallest_draws_of_each_label(spark):
    rng = np.random.default_rng(1)
    made = [(int(k), ["a", "b", "c", None][rng.choice(4, p=[0.9, 0.05, 0.03, 0.02])], int(rng.integers(-(2**62), 2**62))) for k in range(5000)]
    df = spark.createDataFrame(made, "id long, label string, draw long")
    got = sorted(r["id"] for r in common.fewest(df, "label", "draw", 150, "id").collect())
    expected = []
    for label in "abc":
        expected += [i for _, i in sorted((d % 2**32, i) for i, name, d in made if name == label)[:150]]
    assert got == sorted(expected)
    assert common.fewest(df.limit(0), "label", "draw", 5).count() == 0


def test_rows_are_cut_before_the_shuffle(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        df = spark.range(100_000).select((F.col("id") % 2).cast("string").alias("label"), F.xxhash64("id").alias("draw"), "id")
        chosen = common.fewest(df, "label", "draw", 100, "id")
        assert chosen.count() == 200
        plan = chosen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("Initial Plan")[-1]
    # Read from the top: the window's exchanges come first, the cut below them.
    assert initial.index("Exchange hashpartitioning") < initial.index("BroadcastHashJoin") and "SortMergeJoin" not in plan
    assert re.search(r"BroadcastExchange", initial)
    monkeypatch.setattr(common, "LABELS", 3)
    with pytest.raises(ValueError, match="labels"):
        common.fewest(spark.range(10).select("id", F.xxhash64("id").alias("draw")), "id", "draw", 1)


def test_facts_of_hot_and_rare_and_missing_keys(spark):
    rows = [(k, "hot" if k < 500 else f"k{k}" if k < 700 else "unknown" if k < 720 else None) for k in range(750)]
    df = spark.createDataFrame(rows, "id long, k string")
    facts = df.filter("k IS NOT NULL AND k <> 'unknown'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    many = facts.unionByName(spark.createDataFrame([("elsewhere", 10_000, 5)], "k string, n long, most long"))
    for some in (facts, many, facts.limit(0)):
        most = {r["k"]: r["most"] for r in some.collect()}
        got = common.join_facts(df, some, ["k"], "n")
        assert got.columns == ["id", "k", "most"]
        assert sorted(tuple(r) for r in got.collect()) == [(i, k, most.get(k)) for i, k in rows]
