"""Column builders for the measures the analyses share.

Reported values are exact decimals: sums stay decimal, one division follows,
one cast rounds half up. Averages of doubles would depend on how rows are
split over tasks. Filters and ranks on raw rates use doubles, where k/n is
correctly rounded and so the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimhound.sources.schema import FLAGS

_WHOLE = "decimal(18,0)"
_TOTAL = "decimal(24,2)"


def dec(value: Column, scale: int, precision: int = 24) -> Column:
    """A decimal; by default wide enough for totals of money over any number of claims."""
    return value.cast(f"decimal({precision},{scale})")


def rows() -> Column:
    return F.count(F.lit(1))


def tally(condition: Column) -> Column:
    """Rows meeting a condition; NULL on an empty input, like any SUM."""
    return F.sum(F.when(condition, 1).otherwise(0))


def is_fraud() -> Column:
    return F.col("Fraud_Label") == 1


def fraud_claims() -> Column:
    return F.sum("Fraud_Label")


def amount_where(condition: Column, amount: str) -> Column:
    return F.sum(F.when(condition, F.col(amount)).otherwise(F.lit(0).cast("decimal(12,2)")))


def fraud_paid() -> Column:
    return amount_where(is_fraud(), "Paid_Amount")


def percent(part: Column, whole: Column, scale: int = 2) -> Column:
    """Share of two whole numbers."""
    return dec(part.cast(_WHOLE) * 100 / F.nullif(whole, F.lit(0)), scale, 12)


def amount_percent(part: Column, whole: Column, scale: int = 1) -> Column:
    """Share of two money sums.

    Sums of sums carry up to 32 digits, which would leave the quotient six
    decimals; 24 digits hold any total and leave it ten.
    """
    part, whole = part.cast(_TOTAL), whole.cast(_TOTAL)
    return dec(part * 100 / F.nullif(whole, F.lit(0).cast(_TOTAL)), scale, 12)


def per(part: Column, whole: Column, scale: int = 2) -> Column:
    """Whole number over whole number."""
    return dec(part.cast(_WHOLE) / F.nullif(whole, F.lit(0)), scale, 12)


def fraud_rate() -> Column:
    return percent(F.sum("Fraud_Label"), F.count("Fraud_Label"))


def raw_fraud_rate() -> Column:
    return F.avg(F.col("Fraud_Label").cast("double"))


def mean_score(scale: int = 1, score: Column | None = None) -> Column:
    value = F.col("Fraud_Risk_Score") if score is None else score
    return dec(F.sum(value).cast(_WHOLE) / F.nullif(F.count(value), F.lit(0)), scale, 12)


def mean_amount(amount: str, scale: int = 2) -> Column:
    return dec(F.sum(amount) / F.nullif(F.count(amount), F.lit(0)), scale, 12)


def thousands(total: Column) -> Column:
    return dec(total / 1000, 1)


def millions(total: Column) -> Column:
    return dec(total / 1000000, 3)


def flag_count() -> Column:
    total = F.col(FLAGS[0])
    for flag in FLAGS[1:]:
        total = total + F.col(flag)
    return total


def all_flags_set() -> Column:
    condition = F.col(FLAGS[0]) == 1
    for flag in FLAGS[1:]:
        condition = condition & (F.col(flag) == 1)
    return condition
