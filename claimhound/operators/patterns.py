"""Fraud patterns: type, specialty, insurer, weekend and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.functions.grouping import aggregate, desc, move_after
from claimhound.functions.measures import (
    all_flags_set,
    dec,
    flag_count,
    fraud_claims,
    fraud_paid,
    fraud_rate,
    is_fraud,
    mean_amount,
    mean_score,
    rows,
    tally,
    thousands,
)
from claimhound.operators.audit import with_share

# The six fraud types, by the column that counts each.
FRAUD_TYPES = {
    "Upcoding": "Upcoding",
    "Unbundling": "Unbundling",
    "Phantom_Billing": "Phantom Billing",
    "Duplicate_Claim": "Duplicate Claim",
    "Identity_Theft": "Medical Identity Theft",
    "Kickback_Referral": "Kickback - Referral",
}
LEGITIMATE = "No Fraud — Legitimate"


def by_fraud_type(claims: DataFrame) -> DataFrame:
    grouped = aggregate(
        claims,
        ["Fraud_Type"],
        {
            "Claims": rows(),
            "Total_Billed": dec(F.sum("Billed_Amount"), 2),
            "Total_Paid": dec(F.sum("Paid_Amount"), 2),
            "Avg_Billed": mean_amount("Billed_Amount"),
            "Avg_Risk_Score": mean_score(),
        },
        distinct={"Providers_Involved": "Provider_ID", "Patients_Affected": "Patient_ID"},
    )
    return (
        with_share(grouped, "Pct_Total")
        .withColumn("Fraud_Type", F.coalesce("Fraud_Type", F.lit(LEGITIMATE)))
        .orderBy(*desc("Claims"), "Fraud_Type")
    )


def type_by_specialty(claims: DataFrame) -> DataFrame:
    return (
        claims.groupBy("Specialty")
        .agg(
            rows().alias("Total_Claims"),
            fraud_claims().alias("Total_Fraud"),
            *[tally(F.col("Fraud_Type") == v).alias(c) for c, v in FRAUD_TYPES.items()],
        )
        .orderBy(*desc("Total_Fraud"), "Specialty")
    )


def by_insurer(claims: DataFrame) -> DataFrame:
    return (
        claims.groupBy("Insurer")
        .agg(
            rows().alias("Total_Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            thousands(fraud_paid()).alias("Fraud_Paid_K"),
            mean_score(score=F.when(is_fraud(), F.col("Fraud_Risk_Score"))).alias("Avg_Fraud_Risk"),
        )
        .orderBy(*desc("Fraud_Paid_K"), "Insurer")
    )


def weekend_split(claims: DataFrame) -> DataFrame:
    kinds = (
        claims.groupBy("Flag_Weekend")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            mean_amount("Billed_Amount").alias("Avg_Billed"),
            mean_score().alias("Avg_Risk_Score"),
        )
        .withColumn("Day_Type", F.when(F.col("Flag_Weekend") == 1, "Weekend").otherwise("Weekday"))
    )
    return move_after(kinds, "Flag_Weekend", "Day_Type")


def all_flag_claims(claims: DataFrame, registry: DataFrame) -> DataFrame:
    facts = registry.select("Provider_ID", "Is_Fraudulent", "License_Valid")
    return (
        claims.filter(all_flags_set())
        .join(facts, "Provider_ID")
        .select(
            "Claim_ID",
            "Provider_ID",
            "Provider_Name",
            "Specialty",
            "Patient_ID",
            "Claim_Date",
            "Fraud_Type",
            F.col("Billed_Amount").alias("Billed"),
            F.col("Paid_Amount").alias("Paid"),
            "Fraud_Risk_Score",
            "Claim_Status",
            "Is_Fraudulent",
            "License_Valid",
        )
        .orderBy(*desc("Fraud_Risk_Score", "Billed"), "Claim_ID")
    )


def by_flag_count(claims: DataFrame, name: str = "Active_Flags") -> DataFrame:
    return (
        claims.withColumn(name, flag_count())
        .groupBy(name)
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            mean_score().alias("Avg_Risk_Score"),
            mean_amount("Billed_Amount").alias("Avg_Billed"),
        )
        .orderBy(name)
    )
