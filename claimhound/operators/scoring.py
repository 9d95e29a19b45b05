"""Composite flag scoring: co-occurrence and score bands."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimhound.functions.bands import SCORE_REST, SCORE_UP_TO, SCORE_ZERO, banded
from claimhound.functions.measures import (
    fraud_claims,
    fraud_rate,
    millions,
    rows,
)
from claimhound.operators.audit import with_share
from claimhound.operators.patterns import by_flag_count
from claimhound.sources.schema import FLAGS

HIGH, WEEKEND, SAME_DAY, MISMATCH, DUPLICATE = FLAGS


def _together(*flags: str) -> Column:
    product = F.col(flags[0])
    for flag in flags[1:]:
        product = product * F.col(flag)
    return F.sum(product)


def co_occurrence(claims: DataFrame) -> DataFrame:
    return claims.agg(
        _together(HIGH).alias("F1_HighValue"),
        _together(WEEKEND).alias("F2_Weekend"),
        _together(SAME_DAY).alias("F3_SameDay"),
        _together(MISMATCH).alias("F4_UnitMismatch"),
        _together(DUPLICATE).alias("F5_Duplicate"),
        _together(HIGH, MISMATCH).alias("F1xF4"),
        _together(HIGH, DUPLICATE).alias("F1xF5"),
        _together(WEEKEND, SAME_DAY).alias("F2xF3"),
        _together(MISMATCH, DUPLICATE).alias("F4xF5"),
        _together(HIGH, WEEKEND, DUPLICATE).alias("F1xF2xF5"),
        _together(*FLAGS).alias("All_5_Flags"),
    )


def score_bands(claims: DataFrame) -> DataFrame:
    """Bands of the risk score; an unknown score falls into the last."""
    score = F.col("Fraud_Risk_Score")
    zero = F.when(score == 0, SCORE_ZERO)
    band = banded(score, operator.le, SCORE_UP_TO, SCORE_REST, first=zero)
    grouped = (
        claims.withColumn("Risk_Band", band)
        .groupBy("Risk_Band")
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            millions(F.sum("Billed_Amount")).alias("Billed_M"),
            F.min(score).alias("lowest"),
        )
    )
    return with_share(grouped, "Pct_Total").orderBy("lowest").drop("lowest")


def flag_count_validation(claims: DataFrame) -> DataFrame:
    return by_flag_count(claims, "TotalFlags")
