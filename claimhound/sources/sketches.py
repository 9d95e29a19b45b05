"""Distinct patients and providers of any period from sketches kept per quarter.

A sketch (HyperLogLog, 2**LG_K registers) is additive where a distinct count is
not: those of quarters and of sets of source files merge to years, insurers or
the whole portfolio without reading a claim again. Its size is fixed, 16 KB at
most, however many patients it has seen. The relative standard error of a merged
sketch is 1.04 / sqrt(2**LG_K); ``BOUND`` is five of them. The exact counts of
the analyses stay as they are.

Cases: null patients and providers are not counted, as in a distinct count; a
group of nothing else has 0; null quarters and insurers are groups of their own;
without claims there are no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimhound.sources.partials import QUARTER, Partials
from claimhound.sources.shared import load_claims

LG_K = 14
BOUND = 5 * 1.04 / 2 ** (LG_K / 2)
COUNTED = {"Patients": "Patient_ID", "Providers": "Provider_ID"}
GROUP = ["Claim_Year", "Insurer"]


def sketch_partials(claims: DataFrame) -> DataFrame:
    """One sketch for each counted column, per quarter and insurer."""
    sketches = [F.hll_sketch_agg(c, LG_K).alias(name) for name, c in COUNTED.items()]
    return claims.groupBy(*QUARTER, "Insurer").agg(*sketches)


def estimated(partials: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Estimated distinct counts per ``by``, any of quarter and insurer, from partial rows alone."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in COUNTED]
    return partials.groupBy(*by).agg(*merged)


def exact(claims: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """The same counts, exactly; each is a distinct pair per group before it is counted."""
    counts = [F.count_distinct(c).alias(name) for name, c in COUNTED.items()]
    return claims.groupBy(*by).agg(*counts)


def _within(name: str) -> Column:
    error = F.abs(F.col(f"e.{name}") - F.col(f"x.{name}"))
    return (error <= F.ceil(F.lit(BOUND) * F.col(f"x.{name}"))).cast("int")


def checked(partials: DataFrame, claims: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Exact counts per group, and 1 where the sketches' estimate is within ``BOUND`` of them."""
    e, x = estimated(partials, by).alias("e"), exact(claims, by).alias("x")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"x.{c}"))
    kept = [F.col(f"x.{c}") for c in [*by, *COUNTED]]
    tests = [F.coalesce(_within(name), F.lit(0)).alias(f"{name}_In_Bound") for name in COUNTED]
    return x.join(e, same, "left").select(*kept, *tests).orderBy(*by)


def sketched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly distinct counts per insurer from sketches refreshed as each year's files arrive."""
    from claimhound.streaming.arrivals import folder, replay, with_time

    claims = load_claims(spark, sf_dir)
    feed, store = folder(spark, "claims-by-year"), folder(spark, "sketches")
    partials = Partials(spark, feed, store, sketch_partials)
    replay(with_time(claims, F.col("Claim_Date")), feed, lambda: partials.refresh())
    return checked(partials.rows(), claims)
