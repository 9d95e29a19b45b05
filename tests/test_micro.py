"""Hand-written cases the derived claims do not contain."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from rows import claims, registry, values

from claimhound.functions.measures import flag_count
from claimhound.operators import (
    audit,
    behaviour,
    financial,
    geography,
    kpi,
    patients,
    patterns,
    payers,
    providers,
    queues,
    report,
    scoring,
    specialty,
    temporal,
)
from claimhound.plans import catalog
from claimhound.sources.schema import CLAIMS, REGISTRY, conform


def many(n: int, **change) -> list[dict]:
    return [dict(change) for _ in range(n)]


def unique(rows: list[dict]) -> list[dict]:
    return [{**r, "Claim_ID": i + 1} for i, r in enumerate(rows)]


def year(y: int, n: int, fraud: int, **change) -> list[dict]:
    return [{"Claim_Year": y, "Fraud_Label": int(i < fraud), **change} for i in range(n)]


def test_lag_skips_years_without_fraud_and_may_fall(spark):
    df = claims(spark, *unique(year(2021, 4, 2) + year(2022, 4, 0) + year(2023, 4, 1)))
    found = providers.yearly_trend(df).orderBy("Claim_Year")
    assert values(found, "Claim_Year", "Prev_Year_Rate", "YoY_Change_PP") == [
        (2021, None, D("0.00")),
        (2023, D("50.00"), D("-25.00")),
    ]


def test_yearly_change_and_growth_may_be_negative(spark):
    df = claims(
        spark,
        *unique(
            year(2021, 2, 2, Paid_Amount="1000000.00") + year(2022, 4, 1, Paid_Amount="500000.00")
        ),
    )
    assert values(temporal.yearly(df), "YoY_Fraud_Change_PP", "Fraud_Paid_Growth_Pct") == [
        (D("0.00"), None),
        (D("-75.00"), D("-75.0")),
    ]


def test_outliers_of_a_code_with_two_descriptions_stay_apart(spark):
    usual = [{"Billed_Amount": f"{100 + i % 3}.00"} for i in range(20)]
    other = [{"Billed_Amount": f"{900 + i % 3}.00", "CPT_Description": "Other"} for i in range(20)]
    high = [{"Billed_Amount": "500.00", "Fraud_Label": 1}]
    alone = [{"CPT_Code": "1", "Billed_Amount": "99999.00"}]
    found = behaviour.billing_outliers(claims(spark, *unique(usual + other + high + alone)))
    rows = values(found, "CPT_Code", "CPT_Description", "Outlier_Claims", "Fraud_Among_Outliers")
    assert rows == [("99213", "Visit", 1, 1)]
    row = found.first()
    mean = (sum(D(100 + i % 3) for i in range(20)) + 500) / 21
    assert row.Expected_Avg == mean.quantize(D("0.01"))
    assert row.Overage_Ratio == (D(500) / mean).quantize(D("0.01"))


def test_outliers_with_an_unknown_description_are_found(spark):
    usual = [{"Billed_Amount": "100.00", "CPT_Description": None}] * 20
    high = [{"Billed_Amount": "500.00", "CPT_Description": None}]
    found = behaviour.billing_outliers(claims(spark, *unique(usual + high)))
    assert values(found, "CPT_Description", "Outlier_Claims") == [(None, 1)]


def test_volume_spike_counts_a_provider_over_its_names(spark):
    rows = (
        year(2022, 2, 0, Provider_Name="Old")
        + year(2022, 1, 0, Provider_Name="New")
        + year(2023, 7, 7, Provider_Name="New")
        + year(2021, 1, 1, Provider_Name="Old")
        + year(2022, 2, 0, Provider_ID=2)
        + year(2023, 4, 0, Provider_ID=2)  # exactly 100 %
        + year(2022, 1, 0, Provider_ID=3)
        + year(2024, 9, 0, Provider_ID=3)  # not the next year
    )
    found = temporal.volume_spikes(claims(spark, *unique(rows)))
    assert values(
        found,
        "Provider_ID",
        "Provider_Name",
        "Prior_Year_Claims",
        "Current_Year_Claims",
        "Volume_Growth_Pct",
        "Overall_Fraud_Rate_Pct",
    ) == [
        (1, "New", 3, 7, D("133.3"), D("87.50")),
        (1, "Old", 3, 7, D("133.3"), D("33.33")),
    ]


def test_unknown_values_fall_into_the_last_band(spark):
    df = claims(spark, {"Patient_Age": None, "Fraud_Risk_Score": None}, {"Patient_Age": 17})
    pr = registry(spark, {"Years_Practice": None})
    assert set(values(patients.by_age_group(df), "Age_Group", "Claims")) == {
        ("65+ Elderly", 1),
        ("0-17  Minor", 1),
    }
    assert values(scoring.score_bands(df), "Risk_Band", "Pct_Total") == [
        ("71-99 Critical", D("50.00")),
        ("1-20 Low", D("50.00")),
    ]
    assert values(specialty.by_experience(df, pr), "Experience_Band", "Claims") == [("20+ yrs", 2)]


@pytest.mark.parametrize(
    "age,band",
    [
        (17, "0-17  Minor"),
        (18, "18-34 Young Adult"),
        (34, "18-34 Young Adult"),
        (35, "35-49 Middle Age"),
        (50, "50-64 Pre-Senior"),
        (65, "65+ Elderly"),
    ],
)
def test_age_band_edges(spark, age, band):
    df = claims(spark, {"Patient_Age": age})
    assert values(patients.by_age_group(df), "Age_Group") == [(band,)]


def test_a_patient_with_two_ages_is_two_rows_with_one_list_of_types(spark):
    fraud = {"Fraud_Label": 1, "Fraud_Type": "Upcoding"}
    rows = [
        {**fraud, "Patient_Age": 40},
        {**fraud, "Patient_Age": 40},
        {**fraud, "Patient_Age": 40, "Fraud_Type": "Unbundling"},
        {**fraud, "Patient_Age": 41, "Fraud_Type": "Phantom Billing"},
        {"Patient_Age": 41},
    ]
    df = claims(spark, *unique(rows))
    ring = behaviour.patient_rings(df, min_providers=1).orderBy("Patient_Age")
    assert values(ring, "Patient_Age", "Fraud_Types") == [
        (40, "Unbundling | Upcoding | Upcoding"),
        (41, "Phantom Billing"),
    ]
    repeat = patients.repeat_fraud(df)
    assert values(repeat, "Patient_Age", "Total_Claims", "Fraud_Types") == [
        (40, 3, "Phantom Billing | Unbundling | Upcoding")
    ]


def test_lists_of_types_order_by_type_and_skip_unknown(spark):
    names = ["A", "A", "A B", None]
    df = claims(spark, *[{"Fraud_Type": t, "Fraud_Label": 1} for t in names])
    ring = behaviour.patient_rings(df, min_providers=1)
    assert values(ring, "Fraud_Types", "Unique_Providers") == [("A | A | A B", 1)]
    nothing = behaviour.patient_rings(claims(spark, {}), min_providers=1)
    assert values(nothing, "Fraud_Types") == [(None,)]


def test_repeat_fraud_of_an_unknown_patient_has_no_list(spark):
    rows = many(3, Patient_ID=None, Fraud_Label=1, Fraud_Type="Upcoding")
    found = patients.repeat_fraud(claims(spark, *unique(rows)))
    assert values(found, "Patient_ID", "Fraud_Claims", "Fraud_Types") == [(None, 3, None)]


def test_zero_divisors(spark):
    zero = {"Allowed_Amount": "0.00", "Billed_Amount": "0.00", "Paid_Amount": "0.00"}
    df = claims(spark, zero)
    assert values(financial.exposure(df), "Pay_Rate_Pct") == [(None,)]
    assert values(financial.specialty_gap(df), "Gap_Pct", "Bill_to_Allow_Ratio") == [(None, None)]
    units = claims(
        spark,
        {"Units_Billed": 0, "Units_Rendered": -1},
        {"Units_Billed": 3, "Units_Rendered": 1, "Billed_Amount": "100.00"},
    )
    assert values(
        financial.overbilled_units(units), "Mismatch_Claims", "Total_Extra_Units", "Est_Overbilled"
    ) == [(2, 3, D("66.67"))]
    assert values(report.leakage_ratio(df), "Leakage_Ratio_Pct", "Multiple_Of_Target") == [
        (None, None)
    ]
    assert values(report.recoverable_loss(df), "Span_Days", "Daily_Burn") == [(0, None)]
    assert values(payers.detection(df), "Detection_Rate_Pct") == [(None,)]


def test_band_uses_the_rounded_rate_and_having_the_raw_one(spark):
    one = claims(spark, {"Network_Status": "Out-of-Network"})
    many_rows = (
        one.drop("Fraud_Label", "Claim_ID")
        .join(spark.range(25000).withColumnRenamed("id", "Claim_ID"))
        .withColumn("Fraud_Label", (F.col("Claim_ID") < 19999).cast("int"))
        .select(*one.columns)
    )
    pr = registry(spark, {"Network_Status": "Out-of-Network"})
    card = providers.scorecard(many_rows, pr)
    assert values(card, "Fraud_Rate_Pct", "Risk_Band", "Risk_Rank") == [(D("80.00"), "CRITICAL", 1)]
    queue = queues.intervention_queue(many_rows, pr)
    assert values(queue, "Intervention") == [("IMMEDIATE SIU INVESTIGATION",)]
    assert providers.out_of_network(many_rows, pr, min_rate=0.79996).isEmpty()
    assert providers.out_of_network(many_rows, pr, min_rate=0.79995).count() == 1


def test_scorecard_rank_has_gaps_after_ties(spark):
    rows = [
        {"Provider_ID": 1, "Fraud_Label": 1},
        {"Provider_ID": 2, "Fraud_Label": 1},
        {"Provider_ID": 3},
        {"Provider_ID": 4, "Fraud_Label": 1, "Fraud_Risk_Score": 90, "Claim_Status": "Denied"},
    ]
    pr = registry(spark, *[{"Provider_ID": i} for i in (1, 2, 3, 4)])
    card = providers.scorecard(claims(spark, *rows), pr)
    assert values(card, "Provider_ID", "Risk_Rank", "Denial_Rate") == [
        (4, 1, D(1)),
        (1, 2, D(0)),
        (2, 2, D(0)),
        (3, 4, D(0)),
    ]


def test_score_points_and_action_edges(spark):
    flags = {f: 1 for f in queues.FLAG_POINTS}
    rows = [
        {"Fraud_Risk_Score": 20, **flags, "Billed_Amount": "10000.01", "Fraud_Label": 1},
        {"Fraud_Risk_Score": 20, "Provider_ID": 2, "Billed_Amount": "10000.00"},
        {"Fraud_Risk_Score": 51},
        {"Fraud_Risk_Score": 50},
    ]
    pr = registry(spark, {}, {"Provider_ID": 2, "Is_Fraudulent": 1, "License_Valid": 0})
    found = queues.priority_claims(claims(spark, *rows), pr)
    assert values(found, "Claim_ID", "Priority_Score", "Total_Flags", "Action_Required") == [
        (1, 120, 5, "URGENT — Full Audit Required"),
        (2, 60, 0, "SCHEDULE — Desk Review"),
        (3, 51, 0, "SCHEDULE — Desk Review"),
        (4, 50, 0, "MONITOR — Low Priority"),
    ]


def test_dashboard_weighs_providers_by_claims_and_drops_orphans(spark):
    rows = [{}, {"Patient_ID": 2}, {"Provider_ID": 2}, {"Provider_ID": 9, "Patient_ID": 9}]
    pr = registry(spark, {"Is_Fraudulent": 1}, {"Provider_ID": 2})
    row = kpi.dashboard(claims(spark, *rows), pr).first()
    assert (row.Total_Claims, row.Unique_Providers, row.Unique_Patients) == (3, 2, 2)
    assert (row.Known_Fraudulent_Providers, row.Known_Fraudulent_Provider_Count) == (2, 1)


def test_states_above_average_round_after_subtracting(spark):
    rows = (
        year(2022, 3, 1, Provider_State="TX")
        + year(2022, 4, 1, Provider_State="NY")
        + year(2022, 7, 2, Provider_State="CA")
    )
    found = geography.above_average(claims(spark, *unique(rows)))
    assert values(found, "Provider_State", "State_Fraud_Pct", "Above_National_PP") == [
        ("TX", D("33.33"), D("4.76"))
    ]


def test_level_one_is_the_overlap_of_the_two_top_lists(spark):
    rows = (
        many(3, Provider_ID=1, Fraud_Label=1, Paid_Amount="1.00")
        + many(2, Provider_ID=2, Fraud_Label=1, Paid_Amount="50.00")
        + many(1, Provider_ID=3, Fraud_Label=1, Paid_Amount="90.00")
    )
    df = claims(spark, *unique(rows))
    assert values(report.top_by_count(df, 2), "Provider_ID") == [(1,), (2,)]
    assert values(report.top_by_paid(df, 2), "Provider_ID") == [(2,), (3,)]
    assert values(report.level_one(df, 2), "Provider_ID") == [(2,)]


def test_hit_list_prefers_license_over_rate(spark):
    rows = [{"Provider_ID": i, "Fraud_Label": 1} for i in (1, 2, 3)]
    pr = registry(
        spark,
        {"Provider_ID": 1, "Is_Fraudulent": 1},
        {"Provider_ID": 2, "Is_Fraudulent": 1, "License_Valid": 0},
    )
    found = providers.hit_list(claims(spark, *rows), pr)
    assert values(found, "Rank", "Provider_ID", "Recommended_Action") == [
        (1, 1, "REVOKE LICENSE + AUDIT"),
        (2, 2, "IMMEDIATE INVESTIGATION"),
    ]


def test_analyses_run_by_name_on_own_tables(spark):
    fa, pr = claims(spark, {"Fraud_Label": 1}), registry(spark, {})
    assert catalog.run("q13a_priority_claims", fa, pr).first().Priority_Score == 40
    assert catalog.run("q00_registry", fa, pr).count() == 1
    assert catalog.run("q01g_unit_mismatches", fa, pr).first().Raw_Mismatch == 0


def test_months_sort_by_calendar(spark):
    df = claims(spark, *[{"Claim_Month": m} for m in ("Dec", "Apr", "Jan")])
    assert values(temporal.monthly(df), "Claim_Month") == [("Jan",), ("Apr",), ("Dec",)]


def test_orphans_include_an_unknown_provider(spark):
    df = claims(spark, {}, {"Provider_ID": None}, {"Provider_ID": 5}, {"Provider_ID": 5})
    found = values(audit.orphan_providers(df, registry(spark, {})), "Provider_ID")
    assert sorted(found, key=str) == [(5,), (None,)]


def test_boolean_flags_become_integers(spark):
    boolean = claims(spark, {"Flag_Weekend": 1}).withColumn(
        "Flag_Weekend", F.col("Flag_Weekend") == 1
    )
    assert conform(boolean, CLAIMS).select(flag_count().alias("n")).first().n == 1


def test_reported_figures(spark):
    """Totals as the report prints them, to check the formulas."""
    base = claims(spark, {}).drop("Claim_ID", "Fraud_Label", "Paid_Amount", "Claim_Date")
    last_fraud, last = F.col("Claim_ID") == 2400, F.col("Claim_ID") == 21999
    paid = (
        F.when(last_fraud, 15699531 - 2400 * 6538)
        .when(F.col("Claim_ID") < 2401, 6538)
        .when(last, 144324534 - 15699531 - 19598 * 6562)
        .otherwise(6562)
    )
    df = (
        base.join(spark.range(22000).withColumnRenamed("id", "Claim_ID"))
        .withColumn("Fraud_Label", (F.col("Claim_ID") < 2401).cast("int"))
        .withColumn("Paid_Amount", paid.cast("decimal(12,2)"))
        .withColumn(
            "Claim_Date",
            F.when(last, F.lit(dt.date(2024, 12, 31))).otherwise(F.lit(dt.date(2020, 12, 31))),
        )
    )
    df = conform(df, CLAIMS)
    assert values(report.cost_profile(df), "Claims", "Avg_Paid")[0] == (2401, D("6538.75"))
    burn = report.recoverable_loss(df).first()
    assert (burn.Recoverable_Loss, burn.Span_Days) == (D("15699531.00"), 1461)
    assert (burn.Daily_Burn, burn.Annualised_Leakage) == (D("10745.74"), D("3922196.31"))
    leak = report.leakage_ratio(df).first()
    assert (leak.Leakage_Ratio_Pct, leak.Multiple_Of_Target) == (D("10.88"), D("2.18"))
    card = {r.KPI: r for r in report.kpi_scorecard(df).collect()}
    assert card["Portfolio Fraud Rate"].Current_Value == D("10.91")
    assert card["Portfolio Fraud Rate"].Meets_2026 == 0
    assert card["Data Completeness"].Meets_2027 == 1


def test_every_analysis_accepts_empty_claims(spark):
    fa, pr = spark.createDataFrame([], CLAIMS), registry(spark, {})
    one_row = {
        "q01b_claims_nulls", "q01f_overpayments", "q01g_unit_mismatches", "q01h1_date_span",
        "q02a_dashboard", "q12a_flag_co_occurrence", "r10_recoverable_loss", "r11_leakage_ratio",
        "r12_top_provider_share", "r18_portfolio_savings",
    }
    for name, analysis in catalog.CLAIMS_ONLY.items():
        want = 1 if name in one_row else 5 if name == "r16_kpi_scorecard" else 0
        assert analysis(fa).count() == want, name
    for name, analysis in catalog.BOTH.items():
        want = 1 if name in one_row else 2 if name == "q01a_row_counts" else 0
        assert analysis(fa, pr).count() == want, name
    empty = spark.createDataFrame([], REGISTRY)
    assert values(audit.registry_null_counts(empty), "Null_State", "Total_Rows") == [(None, 0)]


def test_weekend_split_and_patterns_label(spark):
    df = claims(spark, {"Flag_Weekend": 1}, {"Fraud_Type": "Upcoding", "Fraud_Label": 1})
    assert set(values(patterns.weekend_split(df), "Flag_Weekend", "Day_Type")) == {
        (0, "Weekday"),
        (1, "Weekend"),
    }
    assert set(values(patterns.by_fraud_type(df), "Fraud_Type")) == {
        ("Upcoding",),
        ("No Fraud — Legitimate",),
    }


TOP = "9999999999.99"


def test_totals_beyond_ten_to_the_sixteenth(spark):
    """The largest legal amount on 1.1 million claims, through every analysis with a money total."""
    one = claims(spark, {"Fraud_Label": 1, "Fraud_Type": "Upcoding", "Flag_Weekend": 1, "Billed_Amount": TOP,
                         "Paid_Amount": TOP, "Units_Billed": 2})
    many = one.crossJoin(spark.range(1_100_000).select(F.col("id"))).drop("id")
    total = D(TOP) * 1_100_000
    assert total > 10**16
    for name, column in {
        "q03a_fraud_types": "Total_Billed", "r01_state_loss_ratio": "Fraud_Paid", "r02_type_impact": "Fraud_Paid",
        "r03_top_by_count": "Fraud_Paid", "r09_fourth_quarter": "Fraud_Paid", "r10_recoverable_loss": "Recoverable_Loss",
        "r11_leakage_ratio": "Total_Paid", "r12_top_provider_share": "Total_Fraud_Paid",
        "q08d_weekend_providers": "Weekend_Billed", "r18_portfolio_savings": "Total_Paid",
    }.items():
        assert catalog.run(name, many, None).first()[column] == total, name
    assert catalog.run("q07d_overbilled_units", many, None).first()["Est_Overbilled"] == total / 2
    over = many.withColumn("Billed_Amount", F.lit(0).cast("decimal(12,2)"))
    assert catalog.run("q01f_overpayments", over, None).first()["Total_Excess_Paid"] == total


def test_claims_without_a_date_are_a_period_of_their_own(spark):
    df = claims(spark, {"Claim_Date": None}, {"Claim_Date": None}, {})
    assert values(catalog.run("r09_fourth_quarter", df, None), "Period", "Claims") == [("No date", 2), ("Q1-Q3", 1)]


def test_analyses_by_name_take_thresholds(spark):
    fa = claims(spark, *[{"Provider_ID": 1 + i % 2, "Fraud_Label": int(i % 4 == 0)} for i in range(8)])
    pr = registry(spark, *[{"Provider_ID": i, "Network_Status": "Out-of-Network"} for i in (1, 2)])
    assert catalog.run("q04d_out_of_network", fa, pr, min_rate=0.6).count() == 0
    assert catalog.run("q04d_out_of_network", fa, pr, min_rate=0.4).count() == 1
    assert catalog.run("x01_streamed_scores", fa, pr).count() == 8


def test_audit_coverage_with_reviewed_providers(spark):
    fa = claims(spark, *[{"Provider_ID": i, "Fraud_Label": 1, "Paid_Amount": f"{i}.00"} for i in range(1, 5)])
    done = spark.createDataFrame([(4,), (4,), (1,), (99,)], "Provider_ID long")
    got = catalog.run("r19_audit_coverage", fa, None, reviewed=done, n=3)
    assert values(got, "Provider_ID", "Reviewed", "Coverage_Pct") == [
        (4, 1, D("33.33")), (3, 0, D("33.33")), (2, 0, D("33.33"))
    ]
    assert {r.Reviewed for r in catalog.run("r19_audit_coverage", fa, None).collect()} == {0}
