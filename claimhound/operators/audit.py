"""Data-quality audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.grouping import move_after
from claimhound.functions.measures import percent, rows, tally


def row_counts(claims: DataFrame, registry: DataFrame) -> DataFrame:
    # The labels users see for the two tables.
    labelled = [("Fraud_Analysis", claims), ("Provider_Registry", registry)]
    first, second = [
        df.agg(rows().alias("Rows")).select(F.lit(label).alias("Table"), "Rows")
        for label, df in labelled
    ]
    return first.unionByName(second)


def _null_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.agg(
        *[tally(F.col(c).isNull()).alias(name) for name, c in columns.items()],
        rows().alias("Total_Rows"),
    )


def claims_null_counts(claims: DataFrame) -> DataFrame:
    return _null_counts(
        claims,
        {
            "Null_ClaimID": "Claim_ID",
            "Null_ProviderID": "Provider_ID",
            "Null_PatientID": "Patient_ID",
            "Null_FraudType": "Fraud_Type",
            "Null_BilledAmt": "Billed_Amount",
            "Null_PaidAmt": "Paid_Amount",
            "Null_ClaimDate": "Claim_Date",
        },
    )


def registry_null_counts(registry: DataFrame) -> DataFrame:
    return _null_counts(
        registry,
        {"Null_ProviderID": "Provider_ID", "Null_Specialty": "Specialty", "Null_State": "State"},
    )


def duplicate_claim_ids(claims: DataFrame) -> DataFrame:
    return claims.groupBy("Claim_ID").agg(rows().alias("Occurrences")).filter("Occurrences > 1")


def orphan_providers(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct first, so the anti join sees one row per provider and not every claim."""
    return (
        claims.select("Provider_ID")
        .distinct()
        .join(registry.select("Provider_ID"), "Provider_ID", "left_anti")
    )


def overpayments(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("Paid_Amount") > F.col("Billed_Amount")).agg(
        rows().alias("Overpayment_Count"),
        F.sum(F.col("Paid_Amount") - F.col("Billed_Amount"))
        .cast("decimal(24,2)")
        .alias("Total_Excess_Paid"),
    )


def unit_mismatches(claims: DataFrame) -> DataFrame:
    differ = F.col("Units_Billed") != F.col("Units_Rendered")
    return claims.agg(
        tally(differ).alias("Raw_Mismatch"),
        F.sum("Flag_UnitMismatch").alias("Flagged_Mismatch"),
        tally(differ & (F.col("Flag_UnitMismatch") == 0)).alias("Missed_By_Flag"),
    )


def date_span(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.min("Claim_Date").alias("Earliest"), F.max("Claim_Date").alias("Latest")
    ).withColumn("Span_Days", F.datediff("Latest", "Earliest"))


def with_share(grouped: DataFrame, name: str) -> DataFrame:
    """Add each group's share of all claims; runs on the few aggregated rows."""
    total = F.sum("Claims").over(Window.partitionBy())
    return move_after(grouped.withColumn(name, percent(F.col("Claims"), total)), "Claims", name)


def claims_per_year(claims: DataFrame) -> DataFrame:
    years = claims.groupBy("Claim_Year").agg(rows().alias("Claims"))
    return with_share(years, "Pct").orderBy("Claim_Year")


def fraud_type_nulls(claims: DataFrame) -> DataFrame:
    return claims.groupBy("Fraud_Label").agg(
        rows().alias("Claims"),
        tally(F.col("Fraud_Type").isNull()).alias("Null_FraudType"),
        tally(F.col("Fraud_Type").isNotNull()).alias("Has_FraudType"),
    )
