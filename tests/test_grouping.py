"""The grouping helpers against the plain forms they replace."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimhound.functions.grouping import (
    aggregate,
    prune_before_top,
    rows_of_groups,
    with_rank,
    would_broadcast,
)
from claimhound.operators import financial, queues
from claimhound.sources.derived import derive_claims
from claimhound.sources.shared import load_claims, load_registry


def test_rank_equals_a_global_window(spark):
    rng = random.Random(7)
    rows = [
        (i, rng.choice([None, 0.0, 0.0, 0.0, 12.5, 99.0]), rng.choice([None, 1.0, 1.5, 2.0]))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "id long, rate double, score double").select(
        "id", F.col("rate").cast("decimal(12,2)"), F.col("score").cast("decimal(12,1)")
    )
    window = Window.orderBy(F.col("rate").desc(), F.col("score").desc())
    plain = df.withColumn("r", F.rank().over(window))
    ours = with_rank(df, "rate", "score", "r")
    assert Counter(ours.collect()) == Counter(plain.select(*ours.columns).collect())


def test_aggregate_equals_native_distinct_with_null_groups_and_a_hot_key(spark):
    rng = random.Random(11)
    rows = [
        (
            "hot" if i % 3 == 0 else rng.choice([None, "a", "b", "c"]),
            rng.choice([None, 1, 2, 3, 4]),
            rng.randrange(100),
            rng.randrange(1000),
        )
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "g string, p int, q int, v long")
    ours = aggregate(
        df,
        ["g"],
        {"n": F.count(F.lit(1)), "s": F.sum("v")},
        distinct={"ps": "p", "qs": "q"},
    )
    plain = df.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("s"),
        F.count_distinct("p").alias("ps"),
        F.count_distinct("q").alias("qs"),
    )
    assert Counter(ours.collect()) == Counter(plain.select(*ours.columns).collect())


def test_aggregate_counts_no_distinct_values_where_all_are_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "g string, p int")
    row = aggregate(df, ["g"], {"n": F.count(F.lit(1))}, distinct={"ps": "p"}).first()
    assert (row.n, row.ps) == (2, 0)


def test_rows_of_groups_matches_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "x", 6), (2, None, 7)], "a int, b string, v int")
    top = df.groupBy("a", "b").agg(F.sum("v").alias("s")).filter("s = 5").limit(3)
    assert [r.v for r in rows_of_groups(df, top, ["a", "b"]).collect()] == [5]


NEVER = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def no_broadcast(spark):
    for key, value in NEVER.items():
        spark.conf.set(key, value)
    yield
    for key in NEVER:
        spark.conf.unset(key)


@pytest.mark.parametrize("analysis", [queues.priority_claims, financial.largest_fraud_claims])
def test_pruned_top_claims_equal_unpruned_ones(spark, sf_dir, analysis, request):
    fa, pr = load_claims(spark, sf_dir), load_registry(spark, sf_dir)
    registries = [pr, pr.filter("Provider_ID % 5 = 1"), pr.union(pr), pr.limit(0)]
    plain = [analysis(fa, r).collect() for r in registries]
    request.getfixturevalue("no_broadcast")
    pruned = [analysis(fa, r) for r in registries]
    assert "scalar-subquery" in pruned[0]._jdf.queryExecution().analyzed().toString()
    assert [df.collect() for df in pruned] == plain


def test_pruning_sets_a_floor_whatever_matches(spark):
    rows = spark.range(3000).selectExpr("id AS k", "CAST(id AS INT) AS s")
    facts = spark.createDataFrame([(5,), (7,)], "k long")
    assert prune_before_top(rows, facts, "k", F.col("s"), 3).count() == 3000  # all are needed
    assert prune_before_top(rows, facts, "k", F.col("s"), 2).count() == 3000 - 5
    enough = spark.createDataFrame([(2999,), (2990,), (2000,), (1,)], "k long")
    kept = prune_before_top(rows, enough, "k", F.col("s"), 2, gain=4)
    assert kept.count() == 3000 - (2990 - 4)
    tied = spark.range(40).selectExpr("id % 2 AS k", "CAST(id % 4 AS INT) AS s")
    assert prune_before_top(tied, facts.selectExpr("k - 5 AS k"), "k", F.col("s"), 5).count() == 20
    unscored = tied.withColumn("s", F.lit(None).cast("int"))
    assert prune_before_top(unscored, tied.select("k").distinct(), "k", F.col("s"), 5).count() == 40


def test_what_the_session_broadcasts(spark, sf_dir, request):
    small = spark.read.parquet(f"{sf_dir}/nation.parquet")
    assert would_broadcast(small) and not would_broadcast(derive_claims(spark, sf_dir))
    request.getfixturevalue("no_broadcast")
    assert not would_broadcast(small)
