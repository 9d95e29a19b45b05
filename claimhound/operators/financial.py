"""Money: exposure, billing gaps, large claims, overbilled units, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.functions.grouping import asc, desc, prune_before_top, would_broadcast
from claimhound.functions.measures import (
    amount_percent,
    dec,
    fraud_claims,
    fraud_paid,
    is_fraud,
    millions,
    rows,
)


def exposure(claims: DataFrame) -> DataFrame:
    billed, paid = F.sum("Billed_Amount"), F.sum("Paid_Amount")
    by_label = (
        claims.groupBy("Fraud_Label")
        .agg(
            rows().alias("Claims"),
            millions(billed).alias("Billed_M"),
            millions(F.sum("Allowed_Amount")).alias("Allowed_M"),
            millions(paid).alias("Paid_M"),
            millions(billed - paid).alias("Denied_Gap_M"),
            amount_percent(paid, billed).alias("Pay_Rate_Pct"),
        )
        .withColumn("Category", F.when(is_fraud(), "Fraudulent").otherwise("Legitimate"))
        .drop("Fraud_Label")
    )
    return by_label.select("Category", *by_label.columns[:-1])


def specialty_gap(claims: DataFrame) -> DataFrame:
    billed, paid = F.sum("Billed_Amount"), F.sum("Paid_Amount")
    nothing = F.lit(0).cast("decimal(1,0)")
    # Each claim's ratio is fixed at six decimals, then averaged exactly.
    ratio = dec(F.col("Billed_Amount") / F.nullif(F.col("Allowed_Amount"), nothing), 6, 18)
    return (
        claims.groupBy("Specialty")
        .agg(
            rows().alias("Claims"),
            millions(billed).alias("Billed_M"),
            millions(paid).alias("Paid_M"),
            millions(billed - paid).alias("Gap_M"),
            amount_percent(billed - paid, billed).alias("Gap_Pct"),
            dec(F.sum(ratio) / F.nullif(F.count(ratio), F.lit(0)), 2, 12).alias(
                "Bill_to_Allow_Ratio"
            ),
        )
        .orderBy(*desc("Gap_M"), "Specialty")
    )


def largest_fraud_claims(
    claims: DataFrame, registry: DataFrame, min_billed: int = 5000, n: int = 50
) -> DataFrame:
    facts = registry.select("Provider_ID", "Is_Fraudulent", "License_Valid")
    large = claims.filter(is_fraud() & (F.col("Billed_Amount") > min_billed))
    if not would_broadcast(facts):
        large = prune_before_top(large, facts, "Provider_ID", F.col("Billed_Amount"), n)
    found = large.join(facts, "Provider_ID").select(
        "Claim_ID",
        "Claim_Date",
        "Provider_Name",
        "Specialty",
        "Provider_State",
        "Patient_ID",
        "Insurer",
        "CPT_Description",
        "Fraud_Type",
        "Units_Billed",
        "Units_Rendered",
        F.col("Billed_Amount").alias("Billed"),
        F.col("Paid_Amount").alias("Paid"),
        "Fraud_Risk_Score",
        "Claim_Status",
        "Is_Fraudulent",
        "License_Valid",
    )
    rest = [c for c in found.columns if c != "Billed"]
    return found.orderBy(*desc("Billed"), *asc(*rest)).limit(n)


def overbilled_units(claims: DataFrame) -> DataFrame:
    extra = F.col("Units_Billed") - F.col("Units_Rendered")
    # Multiplied before dividing, and fixed at six decimals per claim.
    overcharge = dec(
        extra * F.col("Billed_Amount") / F.nullif(F.col("Units_Billed"), F.lit(0)), 6, 18
    )
    return (
        claims.filter(F.col("Units_Billed") > F.col("Units_Rendered"))
        .groupBy("Provider_ID", "Provider_Name", "Specialty")
        .agg(
            rows().alias("Mismatch_Claims"),
            F.sum(extra).alias("Total_Extra_Units"),
            dec(F.sum(extra).cast("decimal(18,0)") / F.count(extra), 2, 12).alias(
                "Avg_Extra_Units"
            ),
            dec(F.sum(overcharge), 2).alias("Est_Overbilled"),
        )
        .orderBy(*desc("Est_Overbilled"), *asc("Provider_ID", "Provider_Name", "Specialty"))
    )


def insurer_pay_rate(claims: DataFrame) -> DataFrame:
    billed, paid = F.sum("Billed_Amount"), F.sum("Paid_Amount")
    return (
        claims.groupBy("Insurer")
        .agg(
            rows().alias("Claims"),
            millions(billed).alias("Billed_M"),
            millions(paid).alias("Paid_M"),
            amount_percent(paid, billed).alias("Pay_Rate_Pct"),
            fraud_claims().alias("Fraud_Claims"),
            millions(fraud_paid()).alias("Fraud_Leakage_M"),
        )
        .orderBy(*desc("Fraud_Leakage_M"), "Insurer")
    )
