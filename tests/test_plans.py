"""Shapes the physical plans must keep."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimhound.operators import audit, financial, kpi, queues, temporal
from claimhound.plans.catalog import queries
from claimhound.sources.shared import load_claims, load_registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphans_use_an_anti_join(spark, sf_dir):
    """On distinct providers when it must shuffle; on the scan itself when it may broadcast."""
    df = lambda: audit.orphan_providers(load_claims(spark, sf_dir), load_registry(spark, sf_dir))
    assert "BroadcastHashJoin" in plan(df()) and "LeftAnti" in plan(df())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(df())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "HashAggregate" in text.split("LeftAnti")[1]


@pytest.mark.parametrize("analysis", [queues.priority_claims, financial.largest_fraud_claims])
def test_top_claims_never_shuffle_claims(spark, sf_dir, analysis):
    text = plan(analysis(load_claims(spark, sf_dir), load_registry(spark, sf_dir)))
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in text and "Exchange SinglePartition" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(temporal.quarterly(load_claims(spark, sf_dir)))
    assert "GreaterThanOrEqual(Claim_Year,2021)" in text
    schema = text.split("ReadSchema: ")[1]
    assert "Patient_ID" not in schema and "Paid_Amount" not in schema


def test_no_cartesian_products_or_python_workers(spark, sf_dir):
    for name, query in queries().items():
        text = plan(query(spark, sf_dir))
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
            assert node not in text, (name, node)


def _below(node):
    """The nodes of an initial plan, from the root, with the path to each."""
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


REDUCES = ("Aggregate", "Limit", "TakeOrdered")


def _unaggregated_single_partitions(node) -> list[str]:
    """Exchanges into one partition with no aggregation or limit on the way down to a branch or leaf."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _unaggregated_single_partitions(node.initialPlan())
    found = []
    if "SinglePartition" in node.simpleString(500) and "Exchange" in node.nodeName():
        path = _below(node)
        while len(path) == 1 and not any(r in path[0].nodeName() for r in REDUCES):
            path = _below(path[0])
        if not path:
            found.append(node.simpleString(500))
    for child in _below(node):
        found += _unaggregated_single_partitions(child)
    return found


def test_single_partition_work_only_follows_aggregation(spark, sf_dir):
    """A window without keys may only see aggregated rows or the rows left by a limit."""
    for name, query in queries().items():
        executed = query(spark, sf_dir)._jdf.queryExecution().executedPlan()
        assert not _unaggregated_single_partitions(executed), name
    claims = load_claims(spark, sf_dir)
    bad = claims.select(F.rank().over(Window.orderBy("Billed_Amount")).alias("r"))
    assert _unaggregated_single_partitions(bad._jdf.queryExecution().executedPlan())


def test_dashboard_pairs_are_distinct_below_the_semi_join(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(kpi.dashboard(load_claims(spark, sf_dir), load_registry(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = text.split("LeftSemi")[1].split("FileScan")[0]
    assert "HashAggregate" in below and "Patient_ID" in below
