"""Every registered query against its SQL, on derived claims."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from claimhound.plans import catalog, oracle

QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


#: The first sort key of the analyses that come in an order, and whether it falls.
SORTED = {
    name: [(key.strip("-"), key.startswith("-"))]
    for name, key in {
        "q01d_duplicate_claims": "-Occurrences", "q01h2_claims_per_year": "Claim_Year",
        "q02b_claim_status": "-Claims", "q03a_fraud_types": "-Claims", "q04a_provider_scorecard": "Risk_Rank",
        "q04b_hit_list": "Rank", "q04c_licensed_fraudulent": "-Fraud_Claims",
        "q04d_out_of_network": "-Fraud_Rate_Pct", "q04e_provider_trend": "-YoY_Change_PP",
        "q04f_claims_per_patient": "-Claims_Per_Patient", "q06a_yearly_trend": "Claim_Year",
        "q06b_quarterly_trend": "Claim_Year", "q06d_rolling_quarters": "Claim_Year",
        "q06e_volume_spikes": "-Volume_Growth_Pct", "q07b_specialty_gap": "-Gap_M",
        "q07c_largest_fraud_claims": "-Billed", "q07d_overbilled_units": "-Est_Overbilled",
        "q08a_crowded_days": "-Claims_That_Day", "q08b_patient_rings": "-Unique_Providers",
        "q08c_billing_outliers": "-Overage_Ratio", "q08d_weekend_providers": "-Weekend_Fraud_Rate_Pct",
        "q13a_priority_claims": "-Priority_Score", "q13b_intervention_queue": "Queue_Position",
        "r01_state_loss_ratio": "-Loss_Ratio_Pct", "r02_type_impact": "Severity_Rank",
        "r03_top_by_count": "-Fraud_Claims", "r04_top_by_paid": "-Fraud_Paid", "r05_level_one": "-Fraud_Paid",
        "r06_peer_benchmark": "-Deviation_Pct", "r07_patient_mills": "-Claims_Per_Patient",
        "r08_weekday": "Day_Number", "r17_quarterly_peers": "Claim_Year", "r19_audit_coverage": "-Fraud_Paid",
    }.items()
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert differences(df, con, SQL[name]) == []
    found = df.collect()
    assert found
    for name_, down in SORTED.get(name, []):
        column = [r[name_] for r in found]
        known = [x for x in column if x is not None]
        assert known == sorted(known, reverse=down), (name, name_)


def test_columns_come_in_the_documented_order(spark, sf_dir, con):
    own_order = {"r06_peer_benchmark", "r07_patient_mills", "r17_quarterly_peers"}
    for name in set(QUERIES) - own_order:
        described = [d[0] for d in con.execute(SQL[name]).description]
        assert QUERIES[name](spark, sf_dir).columns == described, name


def test_comparison_notices_a_wrong_value(spark, sf_dir, con):
    name = "q01g_unit_mismatches"
    wrong = SQL[name].replace("Flag_UnitMismatch = 0) AS", "Flag_UnitMismatch = 1) AS")
    assert wrong != SQL[name]
    assert differences(QUERIES[name](spark, sf_dir), con, wrong)


def test_entry(spark):
    assert contract.entry(spark).count() == 50
