"""Partitioned and bucketed claims: same answers, pruned years, no exchange of claims."""

from __future__ import annotations

from collections import Counter

import pytest
from compare import differences, duck
from rows import claims
from test_plans import plan

from claimhound.operators import queues, temporal
from claimhound.plans.catalog import queries
from claimhound.plans.oracle import oracle_sql
from claimhound.sources import layout
from claimhound.sources.shared import load_claims, load_registry


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return layout.bucketed(spark, load_claims(spark, sf_dir), load_registry(spark, sf_dir))


def test_query_equals_its_sql(spark, sf_dir):
    name = "x07_bucketed_priority"
    assert not differences(queries()[name](spark, sf_dir), duck(sf_dir), oracle_sql()[name])


def test_rows_and_columns_are_kept(spark, sf_dir, tables):
    before = load_claims(spark, sf_dir), load_registry(spark, sf_dir)
    for old, new in zip(before, tables, strict=True):
        assert old.dtypes == new.dtypes and Counter(old.collect()) == Counter(new.collect())


def test_years_are_pruned(spark, tables):
    text = plan(temporal.quarterly(tables[0]))
    assert "(Claim_Year" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_a_large_registry_is_joined_without_an_exchange(spark, sf_dir, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = plan(queues.score_claims(load_claims(spark, sf_dir), load_registry(spark, sf_dir)))
        joined = queues.score_claims(*tables)
        assert "Exchange hashpartitioning" in moved
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert "Exchange" not in plan(tables[0].groupBy("Provider_ID").count())
        want = queues.priority_claims(load_claims(spark, sf_dir), load_registry(spark, sf_dir)).collect()
        assert queues.priority_claims(*tables).collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_provider_is_written_by_several_tasks(spark, tmp_path):
    """Nulls and an empty table too."""
    rows = [{"Provider_ID": 7}] * 60 + [{"Provider_ID": None}, {"Claim_Year": None}, {"Claim_ID": None}]
    df = claims(spark, *rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share a task
    try:
        hot = layout.save_claims(df, "layout_hot", str(tmp_path / "hot"), buckets=4, spread=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(hot.collect()) == Counter(df.collect())
    files = [f for f in hot.where("Claim_Year = 2022").inputFiles() if "Claim_Year=2022" in f]
    held = [spark.read.parquet(f).where("Provider_ID = 7").count() for f in files]
    assert sum(held) == 60 and 1 < sum(n > 0 for n in held) <= 4
    none = layout.save_claims(df.limit(0), "layout_none", str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == df.columns
