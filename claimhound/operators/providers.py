"""Provider risk: scorecard, hit list, compliance gaps, trend and density.

Claims are always summed per provider before the registry is joined, so a
provider with a third of all claims is one row by then.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.bands import banded
from claimhound.functions.grouping import (
    aggregate,
    asc,
    desc,
    move_after,
    number_rows,
    with_rank,
)
from claimhound.functions.measures import (
    dec,
    fraud_claims,
    fraud_rate,
    mean_amount,
    mean_score,
    per,
    percent,
    rows,
    tally,
    thousands,
)

# Actions of the hit list.
REVOKE = "REVOKE LICENSE + AUDIT"
INVESTIGATE = "IMMEDIATE INVESTIGATION"
AUDIT = "PRIORITY AUDIT"
PROVIDER = ["Provider_ID", "Provider_Name", "Specialty", "Provider_State"]


def scorecard(
    claims: DataFrame,
    registry: DataFrame,
    critical: int = 80,
    high: int = 50,
    moderate: int = 25,
    low: int = 10,
) -> DataFrame:
    """Every registered provider with its measures, risk band and rank."""
    stats = aggregate(
        claims,
        PROVIDER,
        {
            "Total_Claims": rows(),
            "Fraud_Claims": fraud_claims(),
            "Fraud_Rate_Pct": fraud_rate(),
            "Total_Billed_K": thousands(F.sum("Billed_Amount")),
            "Total_Paid_K": thousands(F.sum("Paid_Amount")),
            "Avg_Claim_Value": mean_amount("Billed_Amount"),
            "Avg_Risk_Score": mean_score(),
            "HighValue_Flags": F.sum("Flag_HighValue"),
            "Weekend_Claims": F.sum("Flag_Weekend"),
            "Unit_Mismatches": F.sum("Flag_UnitMismatch"),
            "Duplicate_Flags": F.sum("Flag_Duplicate"),
            "SameDay_Flags": F.sum("Flag_SameDay_Volume"),
            "Denied": tally(F.col("Claim_Status") == "Denied"),
        },
        distinct={"Unique_Patients": "Patient_ID"},
    )
    facts = registry.select(
        "Provider_ID", "Is_Fraudulent", "License_Valid", "Years_Practice", "Network_Status"
    )
    bands = [(critical, "CRITICAL"), (high, "HIGH"), (moderate, "MODERATE"), (low, "LOW")]
    cards = (
        stats.join(facts, "Provider_ID")
        .withColumn("Claims_Per_Patient", per(F.col("Total_Claims"), F.col("Unique_Patients")))
        .withColumn(
            "Denial_Rate", dec(F.col("Denied").cast("decimal(18,0)") / F.col("Total_Claims"), 12, 18)
        )
        .drop("Denied")
        .withColumn(
            "Risk_Band", banded(F.col("Fraud_Rate_Pct"), operator.ge, bands, "CLEAN")
        )
    )
    cards = move_after(cards, "SameDay_Flags", "Claims_Per_Patient", "Denial_Rate")
    ranked = with_rank(cards, "Fraud_Rate_Pct", "Avg_Risk_Score", "Risk_Rank")
    return ranked.orderBy("Risk_Rank", *asc(*PROVIDER))


def provider_scores(claims: DataFrame) -> DataFrame:
    """Per-provider measures behind the hit list and the intervention queue."""
    return claims.groupBy(*PROVIDER).agg(
        rows().alias("Total_Claims"),
        fraud_claims().alias("Fraud_Claims"),
        fraud_rate().alias("Fraud_Rate_Pct"),
        mean_score().alias("Avg_Risk_Score"),
        thousands(F.sum("Billed_Amount")).alias("Billed_K"),
        F.sum("Flag_UnitMismatch").alias("Unit_Mismatches"),
        F.sum("Flag_Duplicate").alias("Dup_Flags"),
        F.sum("Flag_Weekend").alias("Weekend_Claims"),
    )


def riskiest_first() -> list[Column]:
    return [*desc("Fraud_Rate_Pct", "Avg_Risk_Score"), *asc(*PROVIDER)]


def hit_list(claims: DataFrame, registry: DataFrame, n: int = 20, critical: int = 80) -> DataFrame:
    facts = registry.select("Provider_ID", "Is_Fraudulent", "License_Valid", "Years_Practice")
    action = (
        F.when(
            (F.col("Is_Fraudulent") == 1) & (F.col("License_Valid") == 1),
            REVOKE,
        )
        .when(F.col("Fraud_Rate_Pct") >= critical, INVESTIGATE)
        .otherwise(AUDIT)
    )
    top = (
        provider_scores(claims)
        .join(facts, "Provider_ID")
        .withColumn("Recommended_Action", action)
        .orderBy(*riskiest_first())
        .limit(n)
    )
    return number_rows(top, "Rank", *riskiest_first()).orderBy("Rank")


def _claims_per_provider(claims: DataFrame) -> DataFrame:
    return claims.groupBy("Provider_ID").agg(
        F.count("Claim_ID").alias("claims"),
        F.sum("Fraud_Label").alias("fraud"),
        F.count("Fraud_Label").alias("labelled"),
        F.sum("Billed_Amount").alias("billed"),
    )


def licensed_fraudulent(claims: DataFrame, registry: DataFrame) -> DataFrame:
    suspects = registry.filter("Is_Fraudulent = 1 AND License_Valid = 1").select(
        "Provider_ID", "Provider_Name", "Specialty", "State", "Years_Practice", "Network_Status"
    )
    return (
        suspects.join(_claims_per_provider(claims), "Provider_ID")
        .groupBy(*suspects.columns)
        .agg(
            F.sum("claims").alias("Total_Claims"),
            F.sum("fraud").alias("Fraud_Claims"),
            percent(F.sum("fraud"), F.sum("labelled")).alias("Fraud_Rate_Pct"),
            thousands(F.sum("billed")).alias("Billed_K"),
        )
        .orderBy(*desc("Fraud_Claims"), "Provider_ID")
    )


def out_of_network(claims: DataFrame, registry: DataFrame, min_rate: float = 0.30) -> DataFrame:
    outside = registry.filter("Network_Status = 'Out-of-Network'").select(
        "Provider_ID", "Provider_Name", "Specialty", "State", "Is_Fraudulent", "License_Valid"
    )
    raw = F.col("fraud").cast("double") / F.nullif(F.col("labelled"), F.lit(0))
    return (
        outside.join(_claims_per_provider(claims), "Provider_ID")
        .groupBy(*outside.columns)
        .agg(
            F.sum("claims").alias("claims"),
            F.sum("fraud").alias("fraud"),
            F.sum("labelled").alias("labelled"),
            F.sum("billed").alias("billed"),
        )
        .filter(raw > min_rate)
        .select(
            "Provider_ID",
            "Provider_Name",
            "Specialty",
            "State",
            F.col("claims").alias("Total_Claims"),
            percent(F.col("fraud"), F.col("labelled")).alias("Fraud_Rate_Pct"),
            thousands(F.col("billed")).alias("Billed_K"),
            "Is_Fraudulent",
            "License_Valid",
        )
        .orderBy(*desc("Fraud_Rate_Pct"), "Provider_ID")
    )


def yearly_trend(claims: DataFrame, from_year: int = 2021, n: int = 30) -> DataFrame:
    """Change of the yearly fraud rate; years without fraud are left out before LAG."""
    yearly = (
        claims.filter(F.col("Claim_Year") >= from_year)
        .groupBy("Provider_ID", "Provider_Name", "Specialty", "Claim_Year")
        .agg(rows().alias("Claims"), fraud_rate().alias("Fraud_Rate_Pct"))
        .filter(F.col("Fraud_Rate_Pct") > 0)
    )
    by_year = Window.partitionBy("Provider_ID").orderBy("Claim_Year", "Provider_Name", "Specialty")
    rate = F.col("Fraud_Rate_Pct")
    return (
        yearly.withColumn("Prev_Year_Rate", F.lag(rate).over(by_year))
        .withColumn("YoY_Change_PP", dec(rate - F.coalesce("Prev_Year_Rate", rate), 2, 12))
        .orderBy(
            *desc("YoY_Change_PP"), *asc("Provider_ID", "Claim_Year", "Provider_Name", "Specialty")
        )
        .limit(n)
    )


def claims_per_patient(claims: DataFrame, n: int = 30) -> DataFrame:
    ratios = (
        claims.groupBy(*PROVIDER)
        .agg(
            F.count_distinct("Patient_ID").alias("Unique_Patients"),
            rows().alias("Total_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
        )
        .withColumn("Claims_Per_Patient", per(F.col("Total_Claims"), F.col("Unique_Patients")))
    )
    ratios = move_after(ratios, "Total_Claims", "Claims_Per_Patient")
    return ratios.orderBy(*desc("Claims_Per_Patient"), *asc(*PROVIDER)).limit(n)
