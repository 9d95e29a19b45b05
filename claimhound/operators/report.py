"""Analyses the fraud report describes beyond the core set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.grouping import asc, desc
from claimhound.functions.measures import (
    amount_percent,
    dec,
    flag_count,
    fraud_claims,
    fraud_paid,
    fraud_rate,
    is_fraud,
    mean_amount,
    per,
    percent,
    rows,
    tally,
)

NAMED = ["Provider_ID", "Provider_Name", "Specialty"]

# Share of paid money above which a state is escalated, share a
# portfolio should stay under, and days used to annualise.
ESCALATE_PCT = 15
LEAKAGE_TARGET_PCT = 5
DAYS_PER_YEAR = 365


def state_loss_ratio(claims: DataFrame, escalate_pct: int = ESCALATE_PCT) -> DataFrame:
    """Fraud paid over all paid, per state and beside the nation (a window over state rows)."""
    nation = Window.partitionBy()
    states = claims.groupBy("Provider_State").agg(
        rows().alias("Claims"),
        fraud_paid().alias("fraud"),
        F.sum("Paid_Amount").alias("paid"),
    )
    return (
        states.withColumn("all_fraud", F.sum("fraud").over(nation))
        .withColumn("all_paid", F.sum("paid").over(nation))
        .select(
            "Provider_State",
            "Claims",
            dec(F.col("fraud"), 2).alias("Fraud_Paid"),
            dec(F.col("paid"), 2).alias("Total_Paid"),
            amount_percent(F.col("fraud"), F.col("paid"), 2).alias("Loss_Ratio_Pct"),
            amount_percent(F.col("all_fraud"), F.col("all_paid"), 2).alias("National_Ratio_Pct"),
            (F.col("fraud") * 100 > F.col("paid") * escalate_pct).cast("int").alias("Escalate"),
        )
        .orderBy(*desc("Loss_Ratio_Pct"), "Provider_State")
    )


def escalated_states(claims: DataFrame, escalate_pct: int = ESCALATE_PCT) -> DataFrame:
    return state_loss_ratio(claims, escalate_pct).filter("Escalate = 1").drop("Escalate")


def type_impact(claims: DataFrame) -> DataFrame:
    """Fraud types by volume and by money, and how far the two ranks lie apart."""
    by_volume = Window.orderBy(F.col("Claims").desc())
    by_money = Window.orderBy(F.col("Fraud_Paid").desc())
    return (
        claims.filter(F.col("Fraud_Type").isNotNull())
        .groupBy("Fraud_Type")
        .agg(rows().alias("Claims"), dec(F.sum("Paid_Amount"), 2).alias("Fraud_Paid"))
        .withColumn("Volume_Rank", F.rank().over(by_volume))
        .withColumn("Severity_Rank", F.rank().over(by_money))
        .withColumn("Rank_Gap", F.col("Volume_Rank") - F.col("Severity_Rank"))
        .orderBy("Severity_Rank", "Fraud_Type")
    )


def _fraud_per_provider(claims: DataFrame) -> DataFrame:
    return (
        claims.filter(is_fraud())
        .groupBy(*NAMED)
        .agg(rows().alias("Fraud_Claims"), dec(F.sum("Paid_Amount"), 2).alias("Fraud_Paid"))
    )


def top_by_count(claims: DataFrame, n: int = 10) -> DataFrame:
    order = [*desc("Fraud_Claims"), *asc(*NAMED)]
    return _fraud_per_provider(claims).orderBy(*order).limit(n)


def top_by_paid(claims: DataFrame, n: int = 10) -> DataFrame:
    order = [*desc("Fraud_Paid"), *asc(*NAMED)]
    return _fraud_per_provider(claims).orderBy(*order).limit(n)


def level_one(claims: DataFrame, n: int = 10) -> DataFrame:
    """Providers on both top lists; equal rows, as both lists carry the same measures."""
    both = top_by_count(claims, n).intersect(top_by_paid(claims, n))
    return both.orderBy(*desc("Fraud_Paid"), *asc(*NAMED))


def _deviation(own: str, peer: str) -> Column:
    """How far a mean lies from its peers' mean, in percent of that."""
    peers = F.nullif(F.col(peer), F.lit(0).cast("decimal(1,0)"))
    return dec((F.col(own) - F.col(peer)) * 100 / peers, 2, 12)


def _against_peers(claims: DataFrame, peer_keys: list[str]) -> DataFrame:
    """Mean billed of each provider beside the mean of all claims with the same ``peer_keys``.

    Claims are read once: the peers' sums are windows over the provider rows.
    """
    own_keys = NAMED + [k for k in peer_keys if k not in NAMED]
    providers = claims.groupBy(*own_keys).agg(
        rows().alias("Claims"),
        F.sum("Billed_Amount").alias("billed"),
        F.count("Billed_Amount").alias("n"),
        fraud_rate().alias("Fraud_Rate_Pct"),
    )
    peers = Window.partitionBy(*peer_keys)
    means = {
        "Avg_Billed": F.col("billed") / F.nullif(F.col("n"), F.lit(0)),
        "Peer_Avg_Billed": F.sum("billed").over(peers)
        / F.nullif(F.sum("n").over(peers), F.lit(0)),
    }
    found = providers.select(
        *own_keys,
        "Claims",
        *[dec(mean, 2, 12).alias(name) for name, mean in means.items()],
        "Fraud_Rate_Pct",
    )
    return found.withColumn("Deviation_Pct", _deviation("Avg_Billed", "Peer_Avg_Billed"))


def peer_benchmark(claims: DataFrame) -> DataFrame:
    """Mean billed of each provider against the mean of the specialty."""
    return _against_peers(claims, ["Specialty"]).orderBy(*desc("Deviation_Pct"), *asc(*NAMED))


def quarterly_peer_benchmark(claims: DataFrame) -> DataFrame:
    """The same per quarter: each specialty's baseline, and every provider's deviation from it."""
    period = ["Claim_Year", "Claim_Quarter"]
    found = _against_peers(claims, ["Specialty", *period])
    return found.orderBy(*asc(*period), *desc("Deviation_Pct"), *asc(*NAMED))


def portfolio_savings(claims: DataFrame) -> DataFrame:
    """What was billed, paid and saved over all claims; an unpaid claim saves all it billed."""
    totals = claims.agg(
        F.sum("Billed_Amount").alias("billed"), F.sum("Paid_Amount").alias("paid")
    )
    saved = F.col("billed") - F.col("paid")
    return totals.select(
        dec(F.col("billed"), 2).alias("Total_Billed"),
        dec(F.col("paid"), 2).alias("Total_Paid"),
        dec(saved, 2).alias("Savings"),
        amount_percent(saved, F.col("billed"), 2).alias("Savings_Rate_Pct"),
    )


def audit_coverage(
    claims: DataFrame, reviewed: DataFrame | None = None, n: int = 10
) -> DataFrame:
    """Which of the top n providers by fraud paid were reviewed, and the share of them.

    ``reviewed`` holds a Provider_ID per reviewed provider; without it none was.
    """
    top = top_by_paid(claims, n)
    if reviewed is None:
        found = top.withColumn("Reviewed", F.lit(0))
    else:
        done = reviewed.select("Provider_ID").distinct().withColumn("Reviewed", F.lit(1))
        found = top.join(done, "Provider_ID", "left").fillna(0, ["Reviewed"])
    whole = Window.partitionBy()  # over the n rows
    return found.select(
        *NAMED,
        "Fraud_Claims",
        "Fraud_Paid",
        "Reviewed",
        percent(F.sum("Reviewed").over(whole), F.count("*").over(whole)).alias("Coverage_Pct"),
    ).orderBy(*desc("Fraud_Paid"), *asc(*NAMED))


def patient_mills(
    claims: DataFrame, min_claims: int = 100, min_claims_per_patient: str = "1.20"
) -> DataFrame:
    """Many claims from few patients. No threshold is given anywhere, so both are parameters."""
    density = per(F.col("Total_Claims"), F.col("Unique_Patients"))
    return (
        claims.groupBy(*NAMED)
        .agg(
            F.count_distinct("Patient_ID").alias("Unique_Patients"),
            rows().alias("Total_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
        )
        .withColumn("Claims_Per_Patient", density)
        .filter(
            (F.col("Total_Claims") >= min_claims)
            & (F.col("Claims_Per_Patient") >= F.lit(min_claims_per_patient).cast("decimal(12,2)"))
        )
        .orderBy(*desc("Claims_Per_Patient"), *asc(*NAMED))
    )


def by_weekday(claims: DataFrame) -> DataFrame:
    return (
        claims.groupBy(
            (F.weekday("Claim_Date") + 1).alias("Day_Number"),
            F.date_format("Claim_Date", "EEEE").alias("Day_Name"),
        )
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            mean_amount("Billed_Amount").alias("Avg_Billed"),
        )
        .orderBy("Day_Number")
    )


def fourth_quarter(claims: DataFrame) -> DataFrame:
    period = (
        F.when(F.quarter("Claim_Date") == 4, "Q4")
        .when(F.quarter("Claim_Date") < 4, "Q1-Q3")
        .otherwise("No date")
    )
    return (
        claims.groupBy(period.alias("Period"))
        .agg(
            rows().alias("Claims"),
            fraud_claims().alias("Fraud_Claims"),
            fraud_rate().alias("Fraud_Rate_Pct"),
            dec(fraud_paid(), 2).alias("Fraud_Paid"),
        )
        .orderBy("Period")
    )


def _span_days() -> Column:
    return F.datediff(F.max("Claim_Date"), F.min("Claim_Date"))


def recoverable_loss(claims: DataFrame) -> DataFrame:
    totals = claims.agg(fraud_paid().alias("fraud"), _span_days().alias("Span_Days"))
    days = F.nullif(F.col("Span_Days"), F.lit(0))
    return totals.select(
        dec(F.col("fraud"), 2).alias("Recoverable_Loss"),
        "Span_Days",
        dec(F.col("fraud") / days, 2).alias("Daily_Burn"),
        dec(F.col("fraud") * DAYS_PER_YEAR / days, 2).alias("Annualised_Leakage"),
    )


def leakage_ratio(claims: DataFrame, target_pct: int = LEAKAGE_TARGET_PCT) -> DataFrame:
    totals = claims.agg(fraud_paid().alias("fraud"), F.sum("Paid_Amount").alias("paid"))
    whole = F.nullif(F.col("paid"), F.lit(0).cast("decimal(1,0)"))
    return totals.select(
        dec(F.col("fraud"), 2).alias("Fraud_Paid"),
        dec(F.col("paid"), 2).alias("Total_Paid"),
        amount_percent(F.col("fraud"), F.col("paid"), 2).alias("Leakage_Ratio_Pct"),
        F.lit(target_pct).alias("Target_Pct"),
        dec(F.col("fraud") * 100 / (whole * target_pct), 2, 12).alias("Multiple_Of_Target"),
    )


def top_provider_share(claims: DataFrame, n: int = 10) -> DataFrame:
    """Share of fraud paid, and of all providers, held by the top n providers by fraud paid."""
    per_provider = claims.groupBy("Provider_ID").agg(fraud_paid().alias("paid"))
    top = per_provider.orderBy(*desc("paid"), "Provider_ID").limit(n)
    sums = top.agg(rows().alias("Top_Providers"), F.sum("paid").alias("top_paid")).unionByName(
        per_provider.agg(rows().alias("All_Providers"), F.sum("paid").alias("all_paid")),
        allowMissingColumns=True,
    )
    one = sums.agg(*[F.max(c).alias(c) for c in sums.columns])
    return one.select(
        "Top_Providers",
        "All_Providers",
        percent(F.col("Top_Providers"), F.col("All_Providers")).alias("Provider_Share_Pct"),
        dec(F.col("top_paid"), 2).alias("Top_Fraud_Paid"),
        dec(F.col("all_paid"), 2).alias("Total_Fraud_Paid"),
        amount_percent(F.col("top_paid"), F.col("all_paid"), 2).alias("Fraud_Share_Pct"),
    )


def cost_profile(claims: DataFrame) -> DataFrame:
    return (
        claims.groupBy(F.when(is_fraud(), "Fraudulent").otherwise("Legitimate").alias("Claim_Type"))
        .agg(rows().alias("Claims"), mean_amount("Paid_Amount").alias("Avg_Paid"))
        .orderBy("Claim_Type")
    )


_CLAIM = ["Claim_ID", "Claim_Date", *NAMED, "Patient_ID", "Fraud_Risk_Score", "Claim_Status"]


def weekend_review(claims: DataFrame) -> DataFrame:
    """Weekend claims that carry at least one other flag."""
    others = flag_count() - F.col("Flag_Weekend")
    return claims.filter((F.col("Flag_Weekend") == 1) & (others >= 1)).select(
        *_CLAIM, F.col("Billed_Amount").alias("Billed"), others.alias("Other_Flags")
    )


def weekend_known_providers(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Weekend claims of providers the registry knows as fraudulent."""
    known = registry.filter("Is_Fraudulent = 1").select("Provider_ID")
    return (
        claims.filter("Flag_Weekend = 1")
        .join(known, "Provider_ID", "left_semi")
        .select(*_CLAIM, F.col("Billed_Amount").alias("Billed"))
    )


def unit_mismatch_holds(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("Units_Billed") != F.col("Units_Rendered")).select(
        *_CLAIM,
        F.col("Billed_Amount").alias("Billed"),
        "Units_Billed",
        "Units_Rendered",
        "Flag_UnitMismatch",
    )


# Targets per KPI for the two years; a rate or burn must stay at or
# below its target, recall and completeness at or above.
TARGETS = [
    ("Portfolio Fraud Rate", "8.00", "5.00", "max"),
    ("Revenue Leakage Ratio", "7.00", "5.00", "max"),
    ("Daily Burn Rate", "7500.00", "5000.00", "max"),
    ("Unit Mismatch Recall", "100.00", "100.00", "min"),
    ("Data Completeness", "100.00", "100.00", "min"),
]


def kpi_scorecard(claims: DataFrame) -> DataFrame:
    """Current KPIs against their targets, one row per KPI the tables can answer."""
    differ = F.col("Units_Billed") != F.col("Units_Rendered")
    required = ["Claim_ID", "Provider_ID", "Billed_Amount", "Claim_Date"]
    present = F.count(required[0])
    for name in required[1:]:
        present = present + F.count(name)
    now = claims.agg(
        fraud_rate().alias("Portfolio Fraud Rate"),
        amount_percent(fraud_paid(), F.sum("Paid_Amount"), 2).alias("Revenue Leakage Ratio"),
        dec(fraud_paid() / F.nullif(_span_days(), F.lit(0)), 2).alias("Daily Burn Rate"),
        percent(tally(differ & (F.col("Flag_UnitMismatch") == 1)), tally(differ)).alias(
            "Unit Mismatch Recall"
        ),
        percent(present, rows() * len(required)).alias("Data Completeness"),
    )

    def money(text: str) -> Column:
        return F.lit(text).cast("decimal(24,2)")

    lines = [
        F.struct(
            F.lit(kpi).alias("KPI"),
            F.col(f"`{kpi}`").cast("decimal(24,2)").alias("Current_Value"),
            money(first).alias("Target_2026"),
            money(second).alias("Target_2027"),
            F.lit(kind).alias("Kind"),
        )
        for kpi, first, second, kind in TARGETS
    ]
    current = F.col("Current_Value")

    def met(target: str) -> Column:
        return (
            F.when(F.col("Kind") == "max", current <= F.col(target))
            .otherwise(current >= F.col(target))
            .cast("int")
        )

    return (
        now.select(F.inline(F.array(*lines)))
        .withColumn("Meets_2026", met("Target_2026"))
        .withColumn("Meets_2027", met("Target_2027"))
        .drop("Kind")
    )
