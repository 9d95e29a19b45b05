"""Executive dashboard and the two portfolio breakdowns beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.functions.grouping import desc, move_after
from claimhound.functions.measures import (
    amount_where,
    dec,
    fraud_claims,
    fraud_paid,
    fraud_rate,
    is_fraud,
    mean_amount,
    mean_score,
    millions,
    percent,
    rows,
    tally,
)
from claimhound.operators.audit import with_share


def dashboard(claims: DataFrame, registry: DataFrame, critical_score: int = 70) -> DataFrame:
    """One row of portfolio KPIs over the claims whose provider is registered.

    Claims are summed per provider and state before they meet the registry, so
    the join handles one row per provider however many claims it has.
    """
    per_provider = claims.groupBy("Provider_ID", "Provider_State").agg(
        rows().alias("n"),
        F.sum("Billed_Amount").alias("billed"),
        F.sum("Allowed_Amount").alias("allowed"),
        F.sum("Paid_Amount").alias("paid"),
        F.sum("Fraud_Label").alias("fraud"),
        F.count("Fraud_Label").alias("labelled"),
        amount_where(is_fraud(), "Billed_Amount").alias("fraud_billed"),
        fraud_paid().alias("fraud_paid"),
        F.sum("Fraud_Risk_Score").alias("score"),
        F.count("Fraud_Risk_Score").alias("scored"),
        tally(F.col("Fraud_Risk_Score") >= critical_score).alias("critical"),
        F.sum("Flag_HighValue").alias("high_value"),
        F.sum("Flag_Weekend").alias("weekend"),
        F.sum("Flag_SameDay_Volume").alias("same_day"),
        F.sum("Flag_UnitMismatch").alias("unit_mismatch"),
        F.sum("Flag_Duplicate").alias("duplicate"),
    )
    facts = registry.select("Provider_ID", "Is_Fraudulent", "License_Valid")
    known = F.col("Is_Fraudulent") == 1
    licensed = known & (F.col("License_Valid") == 1)
    totals = (
        per_provider.join(facts, "Provider_ID")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("Total_Claims"),
            F.count_distinct("Provider_ID").alias("Unique_Providers"),
            F.count_distinct("Provider_State").alias("States_Covered"),
            millions(F.sum("billed")).alias("Total_Billed_M"),
            millions(F.sum("allowed")).alias("Total_Allowed_M"),
            millions(F.sum("paid")).alias("Total_Paid_M"),
            millions(F.sum("billed") - F.sum("paid")).alias("Billed_vs_Paid_Gap_M"),
            F.sum("fraud").alias("Confirmed_Fraud_Claims"),
            percent(F.sum("fraud"), F.sum("labelled")).alias("Overall_Fraud_Rate_Pct"),
            millions(F.sum("fraud_billed")).alias("Fraud_Billed_M"),
            millions(F.sum("fraud_paid")).alias("Fraud_Paid_M"),
            dec(
                F.sum("score").cast("decimal(18,0)") / F.nullif(F.sum("scored"), F.lit(0)), 2, 12
            ).alias("Avg_Risk_Score"),
            F.sum("critical").alias("Critical_Risk_Claims"),
            F.sum("high_value").alias("Flag_HighValue"),
            F.sum("weekend").alias("Flag_Weekend"),
            F.sum("same_day").alias("Flag_SameDay"),
            F.sum("unit_mismatch").alias("Flag_UnitMismatch"),
            F.sum("duplicate").alias("Flag_Duplicate"),
            # Weighted by claims: the sums run over joined claims, not providers.
            F.sum(F.col("Is_Fraudulent") * F.col("n")).alias("Known_Fraudulent_Providers"),
            F.sum(F.when(licensed, F.col("n")).otherwise(0)).alias("Fraudulent_Still_Licensed"),
            F.count_distinct(F.when(known, F.col("Provider_ID"))).alias(
                "Known_Fraudulent_Provider_Count"
            ),
            F.count_distinct(F.when(licensed, F.col("Provider_ID"))).alias(
                "Fraudulent_Still_Licensed_Count"
            ),
        )
    )
    patients = (
        claims.select("Provider_ID", "Patient_ID")
        .distinct()  # before the semi-join, so that a provider's claims are not shuffled for it
        .join(facts, "Provider_ID", "left_semi")
        .agg(F.count_distinct("Patient_ID").alias("Unique_Patients"))
    )
    # Two one-row frames side by side, through stacking rather than a join.
    stacked = totals.unionByName(patients, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return move_after(one, "Unique_Providers", "Unique_Patients")


def by_status(claims: DataFrame) -> DataFrame:
    grouped = claims.groupBy("Claim_Status").agg(
        rows().alias("Claims"),
        fraud_claims().alias("Fraud_Claims"),
        fraud_rate().alias("Fraud_Rate_Pct"),
        dec(F.sum("Billed_Amount") / 1000, 1).alias("Billed_K"),
        dec(F.sum("Paid_Amount") / 1000, 1).alias("Paid_K"),
        mean_score().alias("Avg_Risk_Score"),
    )
    return with_share(grouped, "Pct_Total").orderBy(*desc("Claims"), "Claim_Status")


def by_network(claims: DataFrame) -> DataFrame:
    return claims.groupBy("Network_Status").agg(
        rows().alias("Claims"),
        fraud_claims().alias("Fraud_Claims"),
        fraud_rate().alias("Fraud_Rate_Pct"),
        millions(F.sum("Billed_Amount")).alias("Billed_M"),
        mean_amount("Billed_Amount").alias("Avg_Billed"),
        mean_score().alias("Avg_Risk_Score"),
    )
