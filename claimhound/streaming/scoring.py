"""Priority scores for a stream of claims, joined to the static registry.

Scoring is stateless: each claim is scored from its own columns and its
provider's registry row, so no watermark or window is needed. The file sink's
log and the checkpoint together give each claim exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimhound.operators.queues import score_claims
from claimhound.sources.schema import CLAIMS
from claimhound.sources.shared import claims_path, load_registry, new_folder, remove_folder


def claims_stream(
    spark: SparkSession,
    path: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """Claims as they arrive in a folder; a micro-batch takes so many files, or so much, at most."""
    reader = spark.readStream.schema(CLAIMS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def start_scoring(
    claims: DataFrame,
    registry: DataFrame,
    sink: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Append scored claims to a parquet folder.

    ``every``: interval between micro-batches of a query that goes on, such as
    "10 seconds"; without it the query ends when the available input is used up.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        score_claims(claims, registry)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def scored_stream(
    spark: SparkSession,
    sf_dir: str,
    *,
    files_per_batch: int | None = None,
    sink: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Run the landed claims through the stream and read the sink.

    A micro-batch takes half as many files as there are cores unless told
    otherwise, so a failed one repeats that much. Without a shared folder,
    ``sink`` and ``checkpoint`` have to be given. A checkpoint of its own is
    removed when the stream has ended; the sink goes with the application.
    """
    source, sink = claims_path(spark, sf_dir), sink or new_folder(spark, "scored")
    log = checkpoint or new_folder(spark, "scored-log")
    if source is None or sink is None or log is None:
        raise ValueError("set spark.checkpoint.dir, or land claims and give sink and checkpoint")
    registry = load_registry(spark, sf_dir)
    files_per_batch = files_per_batch or max(1, spark.sparkContext.defaultParallelism // 2)
    claims = claims_stream(spark, source, files_per_batch)
    start_scoring(claims, registry, sink, log).awaitTermination()
    if checkpoint is None:
        remove_folder(spark, log)
    batch = score_claims(spark.read.schema(CLAIMS).parquet(source), registry)
    return spark.read.schema(batch.schema).parquet(sink)
