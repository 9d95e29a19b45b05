"""Structure between providers and patients: rings, near-duplicate claims, churning, turning points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimhound.functions.grouping import asc, desc
from claimhound.functions.measures import dec, rows
from claimhound.sources.shared import new_folder, remove_folder


class _Steps:
    """Tables of one computation in the shared folder; a step's folder goes when the next is written."""

    def __init__(self, df: DataFrame):
        self.spark, self.last = df.sparkSession, None

    def write(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "ring-links")
        if path is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        df.write.parquet(path)
        if self.last:
            remove_folder(self.spark, self.last)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """node, ring for the nodes of ``links`` (a, b): the smallest node that each one reaches.

    Every round links each node's larger neighbours to its smallest one, and
    then the smaller ones. Both are aggregations that combine before they
    shuffle and joins that Spark can split, so a node with many neighbours is
    not one task's work. The sum of distances to the smallest neighbours falls
    until all are stars.
    """
    steps = _Steps(links)
    now = steps.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = steps.write(down.union(low).toDF("a", "b").distinct())
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("ring"))
    return ends.union(now.select(F.col("b"), F.col("b")).distinct())


def fraud_rings(claims: DataFrame, min_claims: int = 3, min_providers: int = 2) -> DataFrame:
    """Providers and patients that fraud connects: rings of ``min_providers`` providers at least.

    A provider and a patient are linked by ``min_claims`` fraud claims or more;
    a ring is what links connect, named by its smallest provider. Claims
    without a provider or patient link nothing.
    """
    pairs = (
        claims.where((F.col("Fraud_Label") == 1) & F.col("Provider_ID").isNotNull() & F.col("Patient_ID").isNotNull())
        .groupBy("Provider_ID", "Patient_ID")
        .agg(rows().alias("n"), F.sum("Paid_Amount").alias("paid"))
        .where(F.col("n") >= min_claims)
    )
    links = pairs.selectExpr("Provider_ID * 2 AS a", "Patient_ID * 2 + 1 AS b")
    found = connected(links).where("node % 2 = 0").selectExpr("CAST(node / 2 AS BIGINT) AS Provider_ID", "ring")
    of_ring = pairs.join(found, "Provider_ID")
    # patients are counted as (ring, patient) pairs first, so one large ring is spread over all tasks
    providers = of_ring.groupBy("ring", "Provider_ID").agg(F.sum("n").alias("n"), F.sum("paid").alias("paid"))
    totals = providers.groupBy("ring").agg(
        F.min("Provider_ID").alias("Ring_ID"), rows().alias("Providers"),
        F.sum("n").alias("Fraud_Claims"), dec(F.coalesce(F.sum("paid"), F.lit(0)), 2).alias("Fraud_Paid"),
    )
    patients = of_ring.select("ring", "Patient_ID").distinct().groupBy("ring").agg(rows().alias("Patients"))
    return (
        totals.where(F.col("Providers") >= min_providers)
        .join(patients, "ring")
        .select("Ring_ID", "Providers", "Patients", "Fraud_Claims", "Fraud_Paid")
        .orderBy(*desc("Fraud_Paid"), *asc("Ring_ID"))
    )


SERVICE = ["Patient_ID", "Provider_ID", "CPT_Code"]


def near_duplicates(claims: DataFrame, days: int = 30) -> DataFrame:
    """Claims that repeat an earlier one of the same patient, provider and code within ``days`` days.

    Of the same date, the smaller Claim_ID is the earlier. Days are dealt in
    bins of ``days`` + 1; a claim also visits the next bin, so every bin holds
    what its own claims look back on. A window over service and bin then counts
    without a pair being made, and a service that fills the table is spread
    over its bins. Claims that lack part of the service, or a date, repeat nothing.
    """
    day = F.date_diff("Claim_Date", F.lit("1970-01-01").cast("date"))
    known = claims.select(*SERVICE, "Claim_ID", "Claim_Date", day.alias("day")).dropna()
    own = F.floor(F.col("day") / F.lit(days + 1))
    visits = known.withColumn("own", own).withColumn("bin", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    by_day = Window.partitionBy(*SERVICE, "bin").orderBy("day")
    same_day = Window.partitionBy(*SERVICE, "bin", "day")
    seen = (
        visits.withColumn("until", F.count(F.lit(1)).over(by_day.rangeBetween(-days, 0)))
        .withColumn("today", F.count(F.lit(1)).over(same_day))
        .withColumn("before", F.rank().over(same_day.orderBy("Claim_ID")) - 1)
        .withColumn("last", F.max("day").over(by_day.rangeBetween(Window.unboundedPreceding, -1)))
    )
    earlier = F.col("until") - F.col("today") + F.col("before")
    gap = F.when(F.col("before") > 0, 0).otherwise(F.col("day") - F.col("last"))
    return (
        seen.where((F.col("bin") == F.col("own")) & (earlier > 0))
        .select(
            "Claim_ID", *SERVICE, "Claim_Date",
            earlier.cast("long").alias("Earlier_Claims"), gap.cast("int").alias("Days_Since"),
        )
        .orderBy("Claim_ID", "Claim_Date")
    )


def churning_runs(claims: DataFrame, gap_days: int = 60, min_claims: int = 4) -> DataFrame:
    """Runs of claims of one provider for one patient, neighbours at most ``gap_days`` days apart.

    Claims are summed per day before they meet in a session, so many claims of
    one pair move as at most a row per day and task.
    """
    days = (
        claims.dropna(subset=["Provider_ID", "Patient_ID", "Claim_Date"])
        .groupBy("Provider_ID", "Patient_ID", "Claim_Date")
        .agg(rows().alias("n"), F.sum("Paid_Amount").alias("paid"))
    )
    session = F.session_window(F.col("Claim_Date").cast("timestamp_ntz"), f"{gap_days} days")
    return (
        days.groupBy("Provider_ID", "Patient_ID", session.alias("run"))
        .agg(
            F.min("Claim_Date").alias("First_Day"),
            F.max("Claim_Date").alias("Last_Day"),
            F.sum("n").alias("Claims"),
            dec(F.coalesce(F.sum("paid"), F.lit(0)), 2).alias("Paid"),
        )
        .where(F.col("Claims") >= min_claims)
        .drop("run")
        .orderBy(*desc("Claims"), *asc("Provider_ID", "Patient_ID", "First_Day"))
    )


def _strongest(counts: str, total: str) -> Column:
    """(size, place, sign) of the largest |n * sum of the first k - k * total|, the first of equals."""
    return F.expr(f"""
        aggregate({counts},
          named_struct('k', 0L, 'so_far', 0L, 'size', 0L, 'place', 0L, 'sign', 0),
          (s, x) -> named_struct(
            'k', s.k + 1,
            'so_far', s.so_far + x,
            'size', greatest(s.size, abs(size({counts}) * (s.so_far + x) - (s.k + 1) * {total})),
            'place', IF(abs(size({counts}) * (s.so_far + x) - (s.k + 1) * {total}) > s.size, s.k + 1, s.place),
            'sign', IF(abs(size({counts}) * (s.so_far + x) - (s.k + 1) * {total}) > s.size,
                       IF(size({counts}) * (s.so_far + x) < (s.k + 1) * {total}, 1, -1), s.sign)))""")


def turning_points(claims: DataFrame, min_quarters: int = 8) -> DataFrame:
    """The quarter after which each provider's fraud claims changed most.

    Over the provider's quarters with claims, in order, the running sum of
    fraud claims less their mean is furthest from zero where their level
    changes. In whole numbers it is n * (sum of the first k) - k * total, so
    equal sizes are equal; the first counts. A provider has a row per quarter
    with claims, so its array is as short as its history.
    """
    quarter = F.concat_ws("-", F.col("Claim_Year").cast("string"), "Claim_Quarter")
    history = (
        claims.dropna(subset=["Provider_ID", "Claim_Year", "Claim_Quarter"])
        .groupBy("Provider_ID", quarter.alias("quarter"))
        .agg(F.sum("Fraud_Label").cast("long").alias("fraud"))
        .groupBy("Provider_ID")
        .agg(F.sort_array(F.collect_list(F.struct("quarter", "fraud"))).alias("h"), F.sum("fraud").alias("Fraud_Claims"))
        .where(F.size("h") >= min_quarters)
        .withColumn("counts", F.col("h.fraud"))
        .withColumn("best", _strongest("counts", "Fraud_Claims"))
    )
    n = F.size("h").cast("long")
    return (
        history.where("best.size > 0")
        .select(
            "Provider_ID",
            n.alias("Quarters"),
            "Fraud_Claims",
            F.expr("h[CAST(best.place AS INT) - 1].quarter").alias("Last_Quarter_Before"),
            F.when(F.col("best.sign") > 0, "Rise").otherwise("Fall").alias("Direction"),
            (F.col("best.size").cast("decimal(18,0)") / n).cast("decimal(12,2)").alias("Strength"),
        )
        .orderBy(*desc("Strength"), *asc("Provider_ID"))
    )
