"""Scored claims in a sink that a replay does not write twice.

Each micro-batch replaces the folder of its own number. A batch that failed
half-way, or that runs again because its commit was lost, puts the same rows in
the same place, so the sink needs no log of its own and other engines read it
as plain folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimhound.operators.queues import score_claims
from claimhound.sources.schema import CLAIMS
from claimhound.sources.shared import claims_path, load_claims, load_registry, remove_folder
from claimhound.streaming.arrivals import folder
from claimhound.streaming.scoring import claims_stream

Write = Callable[[DataFrame, str], None]


def replace_folder(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def start_replacing(
    scored: DataFrame, sink: str, checkpoint: str, every: str | None = None, write: Write = replace_folder
) -> StreamingQuery:
    """Write each micro-batch of ``scored`` to ``sink``/batch=<its number>."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def replace(rows: DataFrame, number: int) -> None:
        write(rows, f"{sink}/batch={number}")

    return (
        scored.writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_batches(spark: SparkSession, sink: str, like: DataFrame) -> DataFrame:
    """All batches of ``sink``, with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(sink).select(*like.columns)


def replayed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed claims scored twice into one sink, the second time without the first's log."""
    sink, source = folder(spark, "replaced"), claims_path(spark, sf_dir)
    registry = load_registry(spark, sf_dir)
    files = max(1, spark.sparkContext.defaultParallelism // 2)
    for _ in range(2):
        log = folder(spark, "replaced-log")
        scored = score_claims(claims_stream(spark, source, files), registry)
        start_replacing(scored, sink, log).awaitTermination()
        remove_folder(spark, log)
    batch = score_claims(load_claims(spark, sf_dir).select(*CLAIMS.fieldNames()), registry)
    return read_batches(spark, sink, batch)
