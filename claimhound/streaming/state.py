"""Streams that remember: claims seen before, and provider-days that are still open."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimhound.functions.grouping import asc, desc
from claimhound.functions.measures import dec, per
from claimhound.sources.shared import load_claims, remove_folder, setting
from claimhound.streaming.arrivals import ARRIVALS, arrivals, folder, replay, with_time

#: What tells a claim apart: a number may be given again to a claim of another date.
CLAIM = ["Claim_ID", "Claim_Date"]
DAY = ["Provider_ID", "Provider_Name", "Specialty"]
#: Longer than the disorder of a year's files and the 30 days in which claims come again.
WITHIN = "400 days"
#: Beyond any claim; closes every day before it.
LAST_DAY = "2999-01-01"
_STORE = "spark.sql.streaming.stateStore"
#: State is kept on the executors' disks, in memory of fixed size, whatever a year holds.
#: Of its versions the last two are kept, of which a restart needs one.
STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "false",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def arrival_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ARRIVALS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def first_submissions(stream: DataFrame, within: str = WITHIN) -> DataFrame:
    """Each claim once: the submission that arrives first.

    A claim is remembered for ``within`` after its submission. The watermark
    follows the latest submission by as much; a row that is older comes too
    late to be compared, and is dropped and counted. A claim that comes again
    after it was forgotten is a new one. Rows without a time are left out.
    """
    timed = stream.where(F.col("Submitted").isNotNull()).withWatermark("Submitted", within)
    return timed.dropDuplicatesWithinWatermark(CLAIM)


def provider_days(stream: DataFrame, delay: str = WITHIN) -> DataFrame:
    """Claims, patients, billed and fraud per provider and day, once the day is closed.

    A day is closed when the watermark, ``delay`` behind the latest row, has
    passed it; rows of closed days are dropped and counted. State is a row per
    open day, provider and patient, so patients are counted exactly and a busy
    provider is spread over its patients.
    """
    timed = stream.where(F.col("Submitted").isNotNull()).withWatermark("Submitted", delay)
    each = timed.groupBy(F.window("Submitted", "1 day").alias("day"), *DAY, "Patient_ID").agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("Billed_Amount").alias("billed"),
        F.sum("Fraud_Label").alias("fraud"),
    )
    return each.groupBy(F.window("day", "1 day").alias("day"), *DAY).agg(
        F.sum("claims").alias("Claims_That_Day"),
        F.count("Patient_ID").alias("Patients_That_Day"),
        F.sum("billed").alias("billed"),
        F.sum("fraud").alias("Fraud_That_Day"),
    )


def append_to(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Run over the available input; the sink's log and the checkpoint give each row once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with ExitStack() as settings:  # a query keeps those it is started with
        for key, value in STATE.items():
            settings.enter_context(setting(stream.sparkSession, key, value))
        return query.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query dropped because they came behind the watermark."""
    return sum(
        int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"]
    )


def deduplicated_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that the stream let through, over years of repeated submissions."""
    feed, sink, log = (folder(spark, n) for n in ("arrivals", "first-submissions", "dedup-log"))

    def run() -> None:
        kept = first_submissions(arrival_stream(spark, feed).select("Submitted", *CLAIM))
        append_to(kept.select(*CLAIM), sink, log).awaitTermination()

    replay(arrivals(load_claims(spark, sf_dir)), feed, run)
    remove_folder(spark, log)
    remove_folder(spark, feed)
    return spark.read.schema("Claim_ID long, Claim_Date date").parquet(sink)


def most_crowded(days: DataFrame, min_claims: int = 10, n: int = 30) -> DataFrame:
    """The busiest closed days of ``provider_days``, as ``behaviour.crowded_days`` has them."""
    keys = [*DAY, "Claim_Date"]
    return (
        days.where(F.col("Claims_That_Day") >= min_claims)
        .select(
            *DAY,
            F.date_from_unix_date((F.unix_seconds("day.start") / 86400).cast("int")).alias("Claim_Date"),
            "Claims_That_Day",
            "Patients_That_Day",
            dec(F.col("billed"), 2).alias("Daily_Billed"),
            "Fraud_That_Day",
            per(F.col("Claims_That_Day"), F.col("Patients_That_Day")).alias("Claims_Per_Patient"),
        )
        .orderBy(*desc("Claims_That_Day"), *asc(*keys))
        .limit(n)
    )


def streamed_crowded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded provider-days, told by the stream as the days close."""
    feed, sink, log = (folder(spark, n) for n in ("claims-by-day", "provider-days", "days-log"))
    kept = ["Submitted", *DAY, "Patient_ID", "Billed_Amount", "Fraud_Label"]

    def days() -> DataFrame:
        return provider_days(arrival_stream(spark, feed).select(*kept))

    def run() -> None:
        append_to(days(), sink, log).awaitTermination()

    claims = load_claims(spark, sf_dir)
    replay(with_time(claims, F.col("Claim_Date")), feed, run)
    end = spark.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in ARRIVALS if f.name != "Submitted"],
    )
    end = with_time(end, F.lit(LAST_DAY).cast("date"))
    end.select(*[f.name for f in ARRIVALS]).write.mode("append").parquet(feed)
    run()
    schema = days().schema
    remove_folder(spark, log)
    remove_folder(spark, feed)
    return most_crowded(spark.read.schema(schema).parquet(sink))
