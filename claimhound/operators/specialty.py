"""Specialty risk and provider experience."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.bands import EXPERIENCE_REST, EXPERIENCE_UP_TO, banded
from claimhound.functions.grouping import aggregate, desc
from claimhound.functions.measures import (
    dec,
    fraud_claims,
    fraud_rate,
    mean_amount,
    mean_score,
    millions,
    percent,
    raw_fraud_rate,
    rows,
)


def scorecard(
    claims: DataFrame,
    high_rate: float = 0.40,
    high_billed: int = 1000000,
    monitor_rate: float = 0.20,
) -> DataFrame:
    """Specialties ranked by raw fraud rate and by money; both windows run over a row per specialty."""
    raw, billed = F.col("raw"), F.col("billed")
    return (
        aggregate(
            claims,
            ["Specialty"],
            {
                "Total_Claims": rows(),
                "Fraud_Claims": fraud_claims(),
                "Fraud_Rate_Pct": fraud_rate(),
                "Billed_M": millions(F.sum("Billed_Amount")),
                "Avg_Billed": mean_amount("Billed_Amount"),
                "Avg_Risk_Score": mean_score(),
                "raw": raw_fraud_rate(),
                "billed": F.sum("Billed_Amount"),
            },
            distinct={"Providers": "Provider_ID"},
        )
        .withColumn("Fraud_Rate_Rank", F.rank().over(Window.orderBy(raw.desc())))
        .withColumn("Revenue_Rank", F.rank().over(Window.orderBy(billed.desc())))
        .withColumn(
            "Investigation_Priority",
            F.when((raw > high_rate) & (billed > high_billed), "HIGH PRIORITY")
            .when(raw > monitor_rate, "MONITOR")
            .otherwise("LOW RISK"),
        )
        .drop("raw", "billed")
        .orderBy("Fraud_Rate_Rank", "Specialty")
    )


def by_experience(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims by years of practice; unknown years fall into the last band."""
    band = banded(F.col("Years_Practice"), operator.le, EXPERIENCE_UP_TO, EXPERIENCE_REST)
    per_provider = claims.groupBy("Provider_ID").agg(
        F.count("Claim_ID").alias("claims"),
        F.sum("Fraud_Label").alias("fraud"),
        F.count("Fraud_Label").alias("labelled"),
        F.sum("Fraud_Risk_Score").alias("score"),
        F.count("Fraud_Risk_Score").alias("scored"),
    )
    return (
        registry.select("Provider_ID", band.alias("Experience_Band"))
        .join(per_provider, "Provider_ID")
        .groupBy("Experience_Band")
        .agg(
            F.count_distinct("Provider_ID").alias("Providers"),
            F.sum("claims").alias("Claims"),
            F.sum("fraud").alias("Fraud_Claims"),
            percent(F.sum("fraud"), F.sum("labelled")).alias("Fraud_Rate_Pct"),
            dec(
                F.sum("score").cast("decimal(18,0)") / F.nullif(F.sum("scored"), F.lit(0)), 1, 12
            ).alias("Avg_Risk_Score"),
        )
        .orderBy(*desc("Fraud_Rate_Pct"), "Experience_Band")
    )
