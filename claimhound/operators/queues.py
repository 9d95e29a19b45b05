"""Investigation queues: scored claims and providers to audit first."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimhound.functions.bands import ACTION_ABOVE, ACTION_REST, banded
from claimhound.functions.grouping import (
    asc,
    desc,
    number_rows,
    prune_before_top,
    would_broadcast,
)
from claimhound.functions.measures import flag_count, is_fraud
from claimhound.operators.providers import provider_scores, riskiest_first

# Points per flag and per registry or claim fact.
FLAG_POINTS = {
    "Flag_HighValue": 10,
    "Flag_Duplicate": 15,
    "Flag_UnitMismatch": 8,
    "Flag_SameDay_Volume": 12,
    "Flag_Weekend": 5,
}
LARGE_BILL_POINTS, LARGE_BILL = 20, 10000
FRAUDULENT_PROVIDER_POINTS = 25
NO_LICENSE_POINTS = 15
FRAUD_LABEL_POINTS = 30
# Interventions of the provider queue.
REFERRAL = "LICENSE REVOCATION + CRIMINAL REFERRAL"
SIU = "IMMEDIATE SIU INVESTIGATION"
FULL_AUDIT = "FULL AUDIT — Billing Review"
MONITORING = "ENHANCED MONITORING"
FACTS = ["Provider_ID", "Is_Fraudulent", "License_Valid", "Years_Practice"]


def points(condition: Column, n: int) -> Column:
    return F.when(condition, n).otherwise(0)


def claim_points() -> Column:
    """The part of the score that needs no registry."""
    score = F.col("Fraud_Risk_Score")
    for flag, n in FLAG_POINTS.items():
        score = score + F.col(flag) * n
    return (
        score
        + points(F.col("Billed_Amount") > LARGE_BILL, LARGE_BILL_POINTS)
        + points(is_fraud(), FRAUD_LABEL_POINTS)
    )


def score_claims(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Score every registered claim; stateless, so it also runs on a stream of claims."""

    score = (
        claim_points()
        + points(F.col("Is_Fraudulent") == 1, FRAUDULENT_PROVIDER_POINTS)
        + points(F.col("License_Valid") == 0, NO_LICENSE_POINTS)
    )
    facts = registry.select(*FACTS)
    return (
        claims.join(facts, "Provider_ID")
        .select(
            score.alias("Priority_Score"),
            "Claim_ID",
            "Claim_Date",
            "Provider_ID",
            "Provider_Name",
            "Specialty",
            "Provider_State",
            "Patient_ID",
            "Insurer",
            "Fraud_Type",
            F.col("Billed_Amount").alias("Billed"),
            F.col("Paid_Amount").alias("Paid"),
            "Claim_Status",
            "Fraud_Risk_Score",
            flag_count().alias("Total_Flags"),
            "Is_Fraudulent",
            "License_Valid",
            "Years_Practice",
        )
        .withColumn(
            "Action_Required",
            banded(F.col("Priority_Score"), operator.gt, ACTION_ABOVE, ACTION_REST),
        )
    )


def priority_claims(claims: DataFrame, registry: DataFrame, n: int = 50) -> DataFrame:
    facts = registry.select(*FACTS)
    if not would_broadcast(facts):
        gain = FRAUDULENT_PROVIDER_POINTS + NO_LICENSE_POINTS
        claims = prune_before_top(claims, facts, "Provider_ID", claim_points(), n, gain)
    scored = score_claims(claims, registry)
    rest = [c for c in scored.columns if c not in ("Priority_Score", "Claim_ID")]
    return scored.orderBy(*desc("Priority_Score"), *asc("Claim_ID", *rest)).limit(n)


def intervention_queue(
    claims: DataFrame, registry: DataFrame, n: int = 25, critical: int = 80, high: int = 50
) -> DataFrame:
    facts = registry.select("Provider_ID", "Is_Fraudulent", "License_Valid", "Network_Status")
    intervention = (
        F.when(
            (F.col("Is_Fraudulent") == 1) & (F.col("License_Valid") == 1),
            REFERRAL,
        )
        .when(F.col("Fraud_Rate_Pct") >= critical, SIU)
        .when(F.col("Fraud_Rate_Pct") >= high, FULL_AUDIT)
        .otherwise(MONITORING)
    )
    top = (
        provider_scores(claims)
        .drop("Weekend_Claims")
        .join(facts, "Provider_ID")
        .withColumn("Intervention", intervention)
        .orderBy(*riskiest_first())
        .limit(n)
    )
    return number_rows(top, "Queue_Position", *riskiest_first()).orderBy("Queue_Position")
