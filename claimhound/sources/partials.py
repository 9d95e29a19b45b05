"""Additive aggregates kept per set of source files, so that a refresh reads new files only.

A part holds the partial rows of the files that one refresh found new. Its list
of files is written last and under the same name, so a part counts once it is
whole, and a refresh that failed is done again in place. A part one of whose
files was replaced or removed no longer counts; its other files are new again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimhound.functions.measures import dec, percent
from claimhound.sources.schema import CLAIMS
from claimhound.sources.shared import _exists, _file_system, _path, load_claims, remove_folder

QUARTER = ["Claim_Year", "Claim_Quarter"]
PARTS = "part string, file string"


def source_files(spark: SparkSession, source: str) -> dict[str, str]:
    """Data files below ``source``: a name that tells path, length and time apart, and the path."""
    path, found = _path(spark, source), {}
    files = _file_system(spark, path).listFiles(path, True)
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found[f"{f.getPath()} {f.getLen()} {f.getModificationTime()}"] = str(f.getPath())
    return found


class Partials:
    """Partial rows of ``aggregate`` over the files of ``source``, below ``store``."""

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        store: str,
        aggregate: Callable[[DataFrame], DataFrame],
        schema: T.StructType = CLAIMS,
    ):
        self.spark, self.source, self.store = spark, source, store
        self.aggregate, self.schema = aggregate, schema

    def _parts(self) -> dict[str, set[str]]:
        if not _exists(self.spark, f"{self.store}/files"):
            return {}
        rows = self.spark.read.schema(PARTS).parquet(f"{self.store}/files").collect()  # a row per file
        parts: dict[str, set[str]] = {}
        for r in rows:
            parts.setdefault(r.part, set()).add(r.file)
        return parts

    def _state(self) -> tuple[dict[str, str], list[str], dict[str, str]]:
        """All files, the parts that count, and the files that none of them holds."""
        now = source_files(self.spark, self.source)
        whole = {part: files for part, files in self._parts().items() if files <= set(now)}
        counted: set[str] = set()
        valid = []
        for part, files in sorted(whole.items()):
            if not files & counted:
                valid.append(part)
                counted |= files
        return now, valid, {name: path for name, path in now.items() if name not in counted}

    def new_rows(self, paths: list[str]) -> DataFrame:
        return self.aggregate(self.spark.read.schema(self.schema).parquet(*sorted(paths)))

    def refresh(self) -> int:
        """Aggregate the files that are new; returns their number."""
        _, _, new = self._state()
        if new:
            part = hashlib.md5("\n".join(sorted(new)).encode()).hexdigest()
            self.new_rows(list(new.values())).write.mode("overwrite").parquet(f"{self.store}/rows/part={part}")
            files = self.spark.createDataFrame([(name,) for name in sorted(new)], "file string")
            files.coalesce(1).write.mode("overwrite").parquet(f"{self.store}/files/part={part}")
        return len(new)

    def rows(self) -> DataFrame:
        """The partial rows of all parts that count, without reading the source."""
        _, valid, _ = self._state()
        empty = self.spark.createDataFrame([], self.schema)
        schema = self.aggregate(empty).schema
        if not valid:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store}/rows/part={p}" for p in valid])

    def compact(self) -> None:
        """Drop the folders of parts that no longer count."""
        _, valid, _ = self._state()
        for part in set(self._parts()) - set(valid):
            for kind in ("files", "rows"):
                remove_folder(self.spark, f"{self.store}/{kind}/part={part}")


def quarter_partials(claims: DataFrame) -> DataFrame:
    """Sums per quarter and provider: additive, and the providers stay countable exactly."""
    return claims.groupBy(*QUARTER, "Provider_ID").agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("Fraud_Label").alias("fraud"),
        F.sum("Billed_Amount").alias("billed"),
        F.sum("Paid_Amount").alias("paid"),
        F.sum(F.when(F.col("Fraud_Label") == 1, F.col("Paid_Amount"))).alias("fraud_paid"),
    )


def quarters(partials: DataFrame) -> DataFrame:
    """The quarterly report from any number of partial rows, distinct providers included."""
    providers = partials.groupBy(*QUARTER, "Provider_ID").agg(
        *[F.sum(c).alias(c) for c in ("claims", "fraud", "billed", "paid", "fraud_paid")]
    )
    zero = F.lit(0)
    return (
        providers.groupBy(*QUARTER)
        .agg(
            F.sum("claims").alias("Claims"),
            F.count("Provider_ID").alias("Providers"),
            F.sum("fraud").alias("Fraud_Claims"),
            percent(F.sum("fraud"), F.sum("claims")).alias("Fraud_Rate_Pct"),
            dec(F.sum("billed"), 2).alias("Billed"),
            dec(F.sum("paid"), 2).alias("Paid"),
            dec(F.coalesce(F.sum("fraud_paid"), zero), 2).alias("Fraud_Paid"),
        )
        .orderBy(*QUARTER)
    )


def refreshed_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarterly report, refreshed after each year of claims arrives."""
    from claimhound.streaming.arrivals import folder, replay, with_time

    feed, store = folder(spark, "claims-by-year"), folder(spark, "partials")
    partials = Partials(spark, feed, store, quarter_partials)
    timed = with_time(load_claims(spark, sf_dir), F.col("Claim_Date"))
    replay(timed, feed, lambda: partials.refresh())
    return quarters(partials.rows())
