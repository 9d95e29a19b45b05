"""Patient demography and patients with repeated fraud."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.functions.bands import AGE_BELOW, AGE_REST, banded
from claimhound.functions.grouping import aggregate, asc, desc, join_groups, rows_of_groups
from claimhound.functions.measures import (
    fraud_claims,
    fraud_paid,
    fraud_rate,
    is_fraud,
    mean_amount,
    rows,
    thousands,
)
from claimhound.operators.behaviour import PATIENT


def by_age_group(claims: DataFrame) -> DataFrame:
    """Five age bands; an unknown age falls into the last."""
    band = banded(F.col("Patient_Age"), operator.lt, AGE_BELOW, AGE_REST)
    return aggregate(
        claims.withColumn("Age_Group", band),
        ["Age_Group"],
        {
            "Claims": rows(),
            "Fraud_Claims": fraud_claims(),
            "Fraud_Rate_Pct": fraud_rate(),
            "Avg_Billed": mean_amount("Billed_Amount"),
            "Fraud_Paid_K": thousands(fraud_paid()),
        },
        distinct={"Unique_Patients": "Patient_ID"},
    ).orderBy(*desc("Fraud_Rate_Pct"), "Age_Group")


def by_gender(claims: DataFrame) -> DataFrame:
    return aggregate(
        claims,
        ["Patient_Gender"],
        {
            "Claims": rows(),
            "Fraud_Claims": fraud_claims(),
            "Fraud_Rate_Pct": fraud_rate(),
            "Avg_Billed": mean_amount("Billed_Amount"),
        },
        distinct={"Unique_Patients": "Patient_ID"},
    )


def repeat_fraud(claims: DataFrame, min_fraud: int = 3, n: int = 20) -> DataFrame:
    """Patients with several fraud claims and the distinct types of them.

    The top patients are chosen on the fraud claims alone; every other measure
    is then computed from the claims of those few. The list of types belongs to
    the patient, across rows that differ in age, gender or state.
    """
    order = [*desc("Fraud_Claims"), *asc(*PATIENT)]
    counted = claims.filter(is_fraud()) if min_fraud >= 1 else claims
    top = (
        counted.groupBy(*PATIENT)
        .agg(fraud_claims().alias("Fraud_Claims"))
        .filter(F.col("Fraud_Claims") >= min_fraud)
        .orderBy(*order)
        .limit(n)
    )
    measured = (
        rows_of_groups(claims, top, PATIENT)
        .groupBy(*PATIENT)
        .agg(
            rows().alias("Total_Claims"),
            fraud_claims().alias("Fraud_Claims"),
            F.count_distinct("Provider_ID").alias("Providers_Seen"),
            F.count_distinct("Insurer").alias("Insurers_Used"),
            thousands(F.sum("Billed_Amount")).alias("Total_Billed_K"),
            thousands(fraud_paid()).alias("Fraud_Paid_K"),
        )
    )
    lists = (
        rows_of_groups(claims, top, ["Patient_ID"])
        .filter(F.col("Patient_ID").isNotNull())
        .select("Patient_ID", "Fraud_Type")
        .distinct()
        .groupBy("Patient_ID")
        .agg(
            F.expr("listagg(Fraud_Type, ' | ') WITHIN GROUP (ORDER BY Fraud_Type)").alias(
                "Fraud_Types"
            )
        )
    )
    return join_groups(measured, lists, ["Patient_ID"], "left").orderBy(*order)
