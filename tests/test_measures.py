"""Rounding of the measures against exact fractions."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimhound.functions.measures import (
    amount_percent,
    mean_amount,
    millions,
    per,
    percent,
    thousands,
)


def half_up(value: Fraction, digits: int) -> Decimal:
    scaled = abs(value) * 10**digits
    whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return (Decimal(whole) * (-1 if value < 0 else 1)).scaleb(-digits)


counts = st.lists(
    st.integers(1, 10**7).flatmap(lambda n: st.tuples(st.integers(0, n), st.just(n))),
    min_size=50,
    max_size=200,
)
relaxed = settings(
    max_examples=5,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


@relaxed
@given(pairs=counts)
def test_percent_and_per_round_half_up(spark, pairs):
    pairs = [*pairs, (103, 4000), (1, 800), (0, 7), (19999, 25000)]
    df = spark.createDataFrame(pairs, "k long, n long")
    found = df.select("k", "n", percent(F.col("k"), F.col("n")), per(F.col("n"), F.col("k")))
    for k, n, pct, ratio in found.collect():
        assert pct == half_up(Fraction(k * 100, n), 2)
        assert ratio == (half_up(Fraction(n, k), 2) if k else None)


@relaxed
@given(pairs=counts)
def test_amounts_round_half_up(spark, pairs):
    rows = [(i, Decimal(k).scaleb(-2), Decimal(n).scaleb(-2)) for i, (k, n) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "g int, a decimal(12,2), b decimal(12,2)")
    groups = df.groupBy((F.col("g") % 7).alias("g")).agg(
        amount_percent(F.sum("a"), F.sum("b")).alias("pct"),
        amount_percent(F.sum("a") - F.sum("b"), F.sum("b"), 2).alias("gap"),
        mean_amount("a").alias("mean"),
        thousands(F.sum("a")).alias("k"),
        millions(F.sum("a")).alias("m"),
    )
    for row in groups.collect():
        mine = [(Fraction(a), Fraction(b)) for i, a, b in rows if i % 7 == row.g]
        a, b = sum(x for x, _ in mine), sum(y for _, y in mine)
        assert row.pct == half_up(a * 100 / b, 1)
        assert row.gap == half_up((a - b) * 100 / b, 2)
        assert row.mean == half_up(a / len(mine), 2)
        assert row.k == half_up(a / 1000, 1)
        assert row.m == half_up(a / 1000000, 3)


def test_sums_of_sums_keep_their_precision(spark):
    df = spark.createDataFrame([(Decimal("1.00"), Decimal("3.00"))], "a decimal(32,2), b decimal(32,2)")
    kind = df.select((F.col("a") * 100 / F.col("b")).alias("x")).schema["x"].dataType
    assert kind.scale < 12  # what amount_percent avoids
    assert df.select(amount_percent(F.col("a"), F.col("b"), 2)).first()[0] == Decimal("33.33")
