"""Behavioural anomalies: crowded days, patient rings, billing outliers, weekends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimhound.functions.grouping import (
    asc,
    desc,
    join_groups,
    rows_of_groups,
)
from claimhound.functions.measures import (
    dec,
    fraud_claims,
    fraud_rate,
    per,
    percent,
    raw_fraud_rate,
    rows,
    thousands,
)

SEPARATOR = " | "
PATIENT = ["Patient_ID", "Patient_Age", "Patient_Gender", "Patient_State"]


def crowded_days(claims: DataFrame, min_claims: int = 10, n: int = 30) -> DataFrame:
    """Provider-days with implausibly many claims.

    Counting rows finds the top days; only their claims are then measured, so
    distinct patients are never shuffled for the other days.
    """
    day = ["Provider_ID", "Provider_Name", "Specialty", "Claim_Date"]
    busiest = (
        claims.groupBy(*day)
        .agg(rows().alias("Claims_That_Day"))
        .filter(F.col("Claims_That_Day") >= min_claims)
        .orderBy(*desc("Claims_That_Day"), *asc(*day))
        .limit(n)
    )
    return (
        rows_of_groups(claims, busiest, day)
        .groupBy(*day)
        .agg(
            rows().alias("Claims_That_Day"),
            F.count_distinct("Patient_ID").alias("Patients_That_Day"),
            dec(F.sum("Billed_Amount"), 2).alias("Daily_Billed"),
            fraud_claims().alias("Fraud_That_Day"),
        )
        .withColumn(
            "Claims_Per_Patient", per(F.col("Claims_That_Day"), F.col("Patients_That_Day"))
        )
        .orderBy(*desc("Claims_That_Day"), *asc(*day))
    )


def _repeated(value: str, count: str) -> Column:
    """``value | value | ...`` for a value counted ``count`` times."""
    separated = F.repeat(F.concat(F.lit(SEPARATOR), value), F.col(count).cast("int"))
    return F.substr(separated, F.lit(len(SEPARATOR) + 1))


def _top_rings(claims: DataFrame, min_providers: int, n: int) -> tuple[DataFrame, DataFrame]:
    """The patients with most providers, and all their claims."""
    top = (
        claims.groupBy(*PATIENT)
        .agg(
            F.count_distinct("Provider_ID").alias("Unique_Providers"),
            thousands(F.sum("Billed_Amount")).alias("Total_Billed_K"),
        )
        .filter(F.col("Unique_Providers") >= min_providers)
        .orderBy(*_rings_first())
        .limit(n)
    )
    return top, rows_of_groups(claims, top, PATIENT)


def _rings_first() -> list[Column]:
    return [*desc("Unique_Providers", "Total_Billed_K"), *asc(*PATIENT)]


def patient_ring_types(claims: DataFrame, min_providers: int = 5, n: int = 30) -> DataFrame:
    """The fraud types of the patients of ``patient_rings`` with their counts, a row each.

    Holds what the list of ``patient_rings`` holds, without its limit of size.
    """
    _, theirs = _top_rings(claims, min_providers, n)
    return (
        theirs.filter(F.col("Fraud_Type").isNotNull())
        .groupBy(*PATIENT, "Fraud_Type")
        .agg(rows().alias("Times"))
        .orderBy(*asc(*PATIENT, "Fraud_Type"))
    )


def patient_rings(claims: DataFrame, min_providers: int = 5, n: int = 30) -> DataFrame:
    """Patients seen by many providers, with every fraud type of every claim listed.

    The top patients are chosen on one distinct count and one sum. Only their
    claims are read again for the rest. The list of types is repeated from counts
    per type; as it names each fraud claim, it is one string as long as the
    patient's claims are many, and Spark's limit of 2 GB is reached at about 10^8
    of them. ``patient_ring_types`` gives the same as counts.
    """
    _, theirs = _top_rings(claims, min_providers, n)
    per_type = theirs.groupBy(*PATIENT, "Fraud_Type").agg(rows().alias("times"))
    lists = (
        per_type.filter(F.col("Fraud_Type").isNotNull())
        .withColumn("part", _repeated("Fraud_Type", "times"))
        .groupBy(*PATIENT)
        .agg(F.expr("listagg(part, ' | ') WITHIN GROUP (ORDER BY Fraud_Type)").alias("Fraud_Types"))
    )
    measured = theirs.groupBy(*PATIENT).agg(
        rows().alias("Total_Claims"),
        F.count_distinct("Provider_ID").alias("Unique_Providers"),
        F.count_distinct("Insurer").alias("Insurers_Used"),
        fraud_claims().alias("Fraud_Claims"),
        thousands(F.sum("Billed_Amount")).alias("Total_Billed_K"),
    )
    return (
        join_groups(measured, lists, PATIENT, "left")
        .select(
            *PATIENT,
            "Total_Claims",
            "Unique_Providers",
            "Insurers_Used",
            "Fraud_Claims",
            percent(F.col("Fraud_Claims"), F.col("Total_Claims"), 1).alias("Fraud_Rate_Pct"),
            "Total_Billed_K",
            "Fraud_Types",
        )
        .orderBy(*_rings_first())
    )


def billing_outliers(claims: DataFrame, sigmas: int = 2) -> DataFrame:
    """Claims billed above mean + ``sigmas`` standard deviations of their code and specialty.

    Mean and deviation come from exact decimal sums, so the limit, and with it
    the set of outliers, does not depend on how the rows were split over tasks.
    Adaptive execution sees the size of the statistics before it joins them.
    """
    group = ["CPT_Code", "CPT_Description", "Specialty"]
    amount = F.col("Billed_Amount")
    stats = (
        claims.groupBy(*group)
        .agg(
            F.count(amount).alias("n"),
            F.sum(amount).alias("total"),
            F.sum(amount * amount).alias("squares"),
        )
        .filter(F.col("n") > 1)
    )
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    variance = (F.col("squares").cast("double") - total * total / n) / (n - 1)
    limit = total / n + sigmas * F.sqrt(F.greatest(variance, F.lit(0.0)))
    limits = stats.select(*group, "n", "total", limit.alias("ucl"))
    # Codes and specialties that are NULL match nothing; a NULL description still does.
    cl, li = claims.alias("c"), limits.alias("l")
    matched = (
        (F.col("c.CPT_Code") == F.col("l.CPT_Code"))
        & (F.col("c.Specialty") == F.col("l.Specialty"))
        & F.col("c.CPT_Description").eqNullSafe(F.col("l.CPT_Description"))
        & (F.col("c.Billed_Amount").cast("double") > F.col("l.ucl"))
    )
    outliers = (
        cl.join(li, matched)
        .groupBy(*[F.col(f"c.{c}").alias(c) for c in group])
        .agg(
            rows().alias("Outlier_Claims"),
            fraud_claims().alias("Fraud_Among_Outliers"),
            F.sum("Billed_Amount").alias("billed"),
            F.max("n").alias("n"),
            F.max("total").alias("total"),
        )
    )
    # The mean of billed / expected over one group is a ratio of means.
    expected = F.nullif(F.col("total"), F.lit(0).cast("decimal(1,0)")) * F.col("Outlier_Claims")
    return outliers.select(
        *group,
        "Outlier_Claims",
        "Fraud_Among_Outliers",
        dec(F.col("billed") / F.col("Outlier_Claims"), 2, 12).alias("Avg_Outlier_Billed"),
        dec(F.col("total") / F.col("n"), 2, 12).alias("Expected_Avg"),
        dec(F.col("billed") * F.col("n") / expected, 2, 12).alias("Overage_Ratio"),
    ).orderBy(*desc("Overage_Ratio"), *asc(*group))


def weekend_providers(
    claims: DataFrame, min_claims: int = 5, min_rate: float = 0.40
) -> DataFrame:
    provider = ["Provider_ID", "Provider_Name", "Specialty", "Provider_State"]
    return (
        claims.filter("Flag_Weekend = 1")
        .groupBy(*provider)
        .agg(
            rows().alias("Weekend_Claims"),
            fraud_claims().alias("Weekend_Fraud"),
            fraud_rate().alias("Weekend_Fraud_Rate_Pct"),
            dec(F.sum("Billed_Amount"), 2).alias("Weekend_Billed"),
            raw_fraud_rate().alias("raw"),
        )
        .filter((F.col("Weekend_Claims") >= min_claims) & (F.col("raw") > min_rate))
        .drop("raw")
        .orderBy(*desc("Weekend_Fraud_Rate_Pct"), *asc(*provider))
    )
