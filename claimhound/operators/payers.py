"""Insurer performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.functions.grouping import aggregate, desc
from claimhound.functions.measures import (
    amount_percent,
    amount_where,
    fraud_claims,
    fraud_paid,
    fraud_rate,
    is_fraud,
    mean_score,
    millions,
    percent,
    rows,
    tally,
    thousands,
)


def exposure_report(claims: DataFrame) -> DataFrame:
    billed, paid = F.sum("Billed_Amount"), F.sum("Paid_Amount")
    return aggregate(
        claims,
        ["Insurer"],
        {
            "Total_Claims": rows(),
            "Billed_M": millions(billed),
            "Paid_M": millions(paid),
            "Pay_Rate_Pct": amount_percent(paid, billed),
            "Fraud_Claims": fraud_claims(),
            "Fraud_Rate_Pct": fraud_rate(),
            "Fraud_Leakage_M": millions(fraud_paid()),
            "Avg_Risk_Score": mean_score(),
        },
        distinct={"Providers_Billing": "Provider_ID", "Patients_Covered": "Patient_ID"},
    ).orderBy(*desc("Fraud_Leakage_M"), "Insurer")


def detection(claims: DataFrame) -> DataFrame:
    """Fraud that was denied against fraud that was approved."""
    caught = is_fraud() & (F.col("Claim_Status") == "Denied")
    slipped = is_fraud() & (F.col("Claim_Status") == "Approved")
    return (
        claims.groupBy("Insurer")
        .agg(
            fraud_claims().alias("Total_Fraud_Claims"),
            tally(caught).alias("Caught_Denied"),
            tally(slipped).alias("Slipped_Approved"),
            percent(tally(caught), fraud_claims(), 1).alias("Detection_Rate_Pct"),
            thousands(amount_where(slipped, "Paid_Amount")).alias("Undetected_Paid_K"),
        )
        .orderBy(*desc("Undetected_Paid_K"), "Insurer")
    )


def specialty_matrix(claims: DataFrame, min_claims: int = 50) -> DataFrame:
    return (
        claims.groupBy("Insurer", "Specialty")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            thousands(fraud_paid()).alias("Fraud_Paid_K"),
        )
        .filter(F.col("Claims") > min_claims)
        .orderBy(*desc("Fraud_Rate_Pct"), "Insurer", "Specialty")
    )
