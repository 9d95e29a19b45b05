"""Trends over years, quarters and months. Windows run over period rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.grouping import asc, desc, move_after
from claimhound.functions.measures import (
    dec,
    fraud_claims,
    fraud_paid,
    fraud_rate,
    mean_amount,
    mean_score,
    millions,
    percent,
    rows,
)

# Month labels in calendar order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def yearly(claims: DataFrame, from_year: int = 2021) -> DataFrame:
    years = (
        claims.filter(F.col("Claim_Year") >= from_year)
        .groupBy("Claim_Year")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            millions(F.sum("Billed_Amount")).alias("Billed_M"),
            millions(fraud_paid()).alias("Fraud_Paid_M"),
            mean_amount("Billed_Amount").alias("Avg_Claim_Value"),
        )
    )
    by_year = Window.orderBy("Claim_Year")
    rate, paid = F.col("Fraud_Rate_Pct"), F.col("Fraud_Paid_M")
    return (
        years.withColumn("Prev_Fraud_Rate_Pct", F.lag(rate).over(by_year))
        .withColumn("prev_paid", F.lag(paid).over(by_year))
        .withColumn(
            "YoY_Fraud_Change_PP", dec(rate - F.coalesce("Prev_Fraud_Rate_Pct", rate), 2, 12)
        )
        .withColumn(
            "Fraud_Paid_Growth_Pct",
            dec(
                (paid - F.col("prev_paid"))
                * 100
                / F.nullif(F.col("prev_paid"), F.lit(0).cast("decimal(1,0)")),
                1,
                18,
            ),
        )
        .drop("prev_paid")
        .orderBy("Claim_Year")
    )


def quarterly(claims: DataFrame, from_year: int = 2021) -> DataFrame:
    return (
        claims.filter(F.col("Claim_Year") >= from_year)
        .groupBy("Claim_Year", "Claim_Quarter")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            millions(F.sum("Billed_Amount")).alias("Billed_M"),
            mean_score().alias("Avg_Risk"),
        )
        .orderBy("Claim_Year", "Claim_Quarter")
    )


def monthly(claims: DataFrame) -> DataFrame:
    calendar = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("Claim_Month"))
    return (
        claims.groupBy("Claim_Month")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            mean_amount("Billed_Amount").alias("Avg_Billed"),
            F.sum("Flag_HighValue").alias("HighValue_Flags"),
        )
        .orderBy(calendar)
    )


def rolling_quarters(claims: DataFrame, from_year: int = 2021, quarters: int = 4) -> DataFrame:
    """Unweighted mean of the rounded rates of this quarter and the ones before it."""
    span = Window.orderBy("Claim_Year", "Claim_Quarter").rowsBetween(1 - quarters, 0)
    return (
        claims.filter(F.col("Claim_Year") >= from_year)
        .groupBy("Claim_Year", "Claim_Quarter")
        .agg(rows().alias("Claims"), fraud_rate().alias("Fraud_Rate"))
        .withColumn("Rolling_4Q_Avg", dec(F.avg("Fraud_Rate").over(span), 2, 12))
        .orderBy("Claim_Year", "Claim_Quarter")
    )


def volume_spikes(
    claims: DataFrame,
    years: Sequence[int] = (2022, 2023, 2024),
    min_growth_pct: int = 100,
    n: int = 20,
) -> DataFrame:
    """Providers whose claims grew by more than ``min_growth_pct`` from one year to the next.

    One pass: claims of each year are counted side by side with the overall
    fraud sums, and the year pairs unfold from that row. A year without claims
    forms no pair. Equal pairs of one provider are one row, as no year is shown.
    """
    counts = [f"claims_{y}" for y in years]
    per_name = (
        claims.filter(F.col("Provider_ID").isNotNull())
        .groupBy("Provider_ID", "Provider_Name", "Specialty")
        .agg(
            *[F.count_if(F.col("Claim_Year") == y).alias(c) for y, c in zip(years, counts)],
            F.sum("Fraud_Label").alias("fraud"),
            F.count("Fraud_Label").alias("labelled"),
        )
    )
    # A provider may appear under several names; its yearly volume is over all of them.
    provider = Window.partitionBy("Provider_ID")
    totals = [F.sum(c).over(provider).alias(c) for c in counts]
    consecutive = [
        F.struct(F.col(a).alias("Prior_Year_Claims"), F.col(b).alias("Current_Year_Claims"))
        for y, z, a, b in zip(years, years[1:], counts, counts[1:])
        if z == y + 1
    ]
    prior, current = F.col("Prior_Year_Claims"), F.col("Current_Year_Claims")
    growth = (current - prior).cast("decimal(18,0)") * 100
    pairs = (
        per_name.select("Provider_ID", "Provider_Name", "Specialty", "fraud", "labelled", *totals)
        .select(
            "Provider_ID",
            "Provider_Name",
            "Specialty",
            F.inline(F.array_distinct(F.array(*consecutive))),
            percent(F.col("fraud"), F.col("labelled")).alias("Overall_Fraud_Rate_Pct"),
        )
        .filter((prior > 0) & (current > 0) & (growth > prior * min_growth_pct))
        .withColumn("Volume_Growth_Pct", dec(growth / prior, 1, 18))
    )
    pairs = move_after(pairs, "Current_Year_Claims", "Volume_Growth_Pct")
    return pairs.orderBy(*desc("Volume_Growth_Pct"), *asc(*pairs.columns[:5])).limit(n)
