"""One provider and one patient hold a third of all claims each, and nothing is broadcast by size."""

from __future__ import annotations

import pytest
from compare import TABLES, differences, duck
from pyspark.sql import functions as F

import __spark_entry__ as contract
from claimhound.operators.queues import score_claims
from claimhound.sources.shared import load_claims, load_registry

JOINS_AND_HOT_GROUPS = [
    "q01e_orphan_providers",
    "q02a_dashboard",
    "q03a_fraud_types",
    "q04a_provider_scorecard",
    "q04b_hit_list",
    "q04d_out_of_network",
    "q04e_provider_trend",
    "q04f_claims_per_patient",
    "q06e_volume_spikes",
    "q07c_largest_fraud_claims",
    "q08a_crowded_days",
    "q08b_patient_rings",
    "q08c_billing_outliers",
    "q10c_repeat_fraud_patients",
    "q11b_experience",
    "q13a_priority_claims",
    "q08b_ring_types",
    "r06_peer_benchmark",
    "r17_quarterly_peers",
    "r19_audit_coverage",
]


@pytest.fixture(scope="module")
def skewed(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duck(sf_dir)
    rows = {
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END"
        " AS o_custkey) FROM orders",
        "lineitem": "SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 3 = 1 THEN 3"
        " ELSE l_suppkey END AS l_suppkey) FROM lineitem",
    }
    for name in TABLES:
        query = rows.get(name, f"SELECT * FROM {name}")
        con.execute(f"COPY ({query}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def shuffled(spark):
    """Shuffle joins only, with thresholds low enough for Spark to split skewed partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", JOINS_AND_HOT_GROUPS)
def test_skewed_claims_match_sql(spark, skewed, shuffled, name):
    df = contract.queries()[name](spark, skewed)
    assert differences(df, duck(skewed), contract.oracle_sql()[name]) == []


def test_a_hot_provider_is_split_in_the_scoring_join(spark, skewed, shuffled):
    claims, orphan = load_claims(spark, skewed), 9
    scored = score_claims(claims, load_registry(spark, skewed))
    assert len(scored.collect()) == claims.filter(F.col("Provider_ID") != orphan).count()
    assert "SortMergeJoin(skew=true)" in scored._jdf.queryExecution().executedPlan().toString()
