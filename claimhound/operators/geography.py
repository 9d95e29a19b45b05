"""State-level analyses. States are few, so windows over state rows are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.grouping import desc
from claimhound.functions.measures import (
    dec,
    fraud_claims,
    fraud_rate,
    mean_score,
    millions,
    raw_fraud_rate,
    rows,
    thousands,
)


def leaderboard(claims: DataFrame) -> DataFrame:
    return (
        claims.groupBy(F.col("Provider_State").alias("State"))
        .agg(
            rows().alias("Total_Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            millions(F.sum("Billed_Amount")).alias("Billed_M"),
            millions(F.sum("Paid_Amount")).alias("Paid_M"),
            mean_score().alias("Avg_Risk_Score"),
            raw_fraud_rate().alias("raw"),
        )
        .withColumn("Fraud_Rate_Rank", F.rank().over(Window.orderBy(F.col("raw").desc())))
        .withColumn("Volume_Rank", F.rank().over(Window.orderBy(F.col("Fraud_Claims").desc())))
        .drop("raw")
        .orderBy(*desc("Fraud_Rate_Pct"), "State")
    )


def above_average(claims: DataFrame) -> DataFrame:
    """States above the national rate; the nation is the sum of its states, so one scan serves."""
    nation = Window.partitionBy()
    states = (
        claims.groupBy("Provider_State")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            F.count("Fraud_Label").alias("labelled"),
        )
        .withColumn("all_labelled", F.sum("labelled").over(nation))
        .withColumn("all_fraud", F.sum("Fraud_Claims").over(nation))
    )
    here = F.col("Fraud_Claims").cast("decimal(18,0)")
    everywhere = F.col("all_fraud").cast("decimal(18,0)")
    here_pct = here * 100 / F.nullif(F.col("labelled"), F.lit(0))
    nation_pct = everywhere * 100 / F.nullif(F.col("all_labelled"), F.lit(0))
    return (
        # k/n > K/N, compared without dividing
        states.filter(here * F.col("all_labelled") > everywhere * F.col("labelled"))
        .select(
            "Provider_State",
            dec(here_pct, 2, 12).alias("State_Fraud_Pct"),
            dec(nation_pct, 2, 12).alias("National_Avg_Pct"),
            # rounded after subtracting, so it may differ by 0.01 from the two columns before
            dec(here_pct - nation_pct, 2, 12).alias("Above_National_PP"),
            "Claims",
            "Fraud_Claims",
        )
        .orderBy(*desc("Above_National_PP"), "Provider_State")
    )


def cross_state(claims: DataFrame, min_claims: int = 30) -> DataFrame:
    return (
        claims.filter(F.col("Provider_State") != F.col("Patient_State"))
        .groupBy("Provider_State", "Patient_State")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            thousands(F.sum("Billed_Amount")).alias("Billed_K"),
        )
        .filter(F.col("Claims") > min_claims)
        .orderBy(*desc("Fraud_Rate_Pct"), "Provider_State", "Patient_State")
    )


def high_volume(claims: DataFrame, min_claims: int = 400, min_rate: float = 0.35) -> DataFrame:
    return (
        claims.groupBy("Provider_State")
        .agg(
            rows().alias("Total_Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            millions(F.sum("Billed_Amount")).alias("Billed_M"),
            raw_fraud_rate().alias("raw"),
        )
        .filter((F.col("Total_Claims") > min_claims) & (F.col("raw") > min_rate))
        .drop("raw")
        .orderBy(*desc("Fraud_Rate_Pct"), "Provider_State")
    )
