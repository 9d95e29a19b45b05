"""Claims as a table partitioned by year and bucketed by provider.

A filter on Claim_Year then reads only its years' folders, and a join or a sum
on Provider_ID needs no exchange of claims: the registry is bucketed alike, so
both sides lie ready. A year's bucket is written by ``spread`` tasks, dealt by
claim number, so that a provider with a third of all claims is not one task's
write. Reading without an exchange keeps a bucket in one task; where a provider
outgrows that, set ``spark.sql.sources.bucketing.enabled`` to false, and the
same table is joined by a shuffle with adaptive skew splitting.

Cases: null years have a folder and null providers a bucket of their own; an
empty table is written and read as one; columns are read back in their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimhound.operators.queues import priority_claims
from claimhound.sources.shared import load_claims, load_registry, new_folder

BUCKETS = 16
SPREAD = 4


def save_claims(claims: DataFrame, name: str, path: str, buckets: int = BUCKETS, spread: int = SPREAD) -> DataFrame:
    """Write ``claims`` below ``path`` as the table ``name``; returns the table."""
    bucket = F.pmod(F.hash("Provider_ID"), F.lit(buckets))  # as Spark tells buckets
    dealt = claims.repartition("Claim_Year", bucket, F.pmod(F.xxhash64("Claim_ID"), F.lit(spread)))
    writer = dealt.write.format("parquet").partitionBy("Claim_Year").bucketBy(buckets, "Provider_ID")
    writer.option("path", path).saveAsTable(name)
    return claims.sparkSession.table(name).select(*claims.columns)


def save_registry(registry: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``registry`` as the table ``name``, in as many buckets as its claims."""
    dealt = registry.repartition(F.pmod(F.hash("Provider_ID"), F.lit(buckets)))
    dealt.write.format("parquet").bucketBy(buckets, "Provider_ID").option("path", path).saveAsTable(name)
    return registry.sparkSession.table(name).select(*registry.columns)


def bucketed(spark: SparkSession, claims: DataFrame, registry: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Both tables written to the shared folder under names of their own."""
    tag, found = uuid.uuid4().hex, []
    for save, df, name in ((save_claims, claims, "claims"), (save_registry, registry, "registry")):
        path = new_folder(spark, f"bucketed-{name}")
        if path is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found.append(save(df, f"{name}_{tag}", path, **options))
    return found[0], found[1]


def bucketed_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim priority queue over the bucketed tables."""
    return priority_claims(*bucketed(spark, load_claims(spark, sf_dir), load_registry(spark, sf_dir)))
