"""Loaders for a user's own claims and registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimhound.sources.schema import CLAIMS, REGISTRY, conform


def read_claims(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return conform(spark.read.format(fmt).load(path), CLAIMS)


def read_registry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return conform(spark.read.format(fmt).load(path), REGISTRY)


def claims_table(spark: SparkSession, name: str) -> DataFrame:
    """Claims from a catalog table or view."""
    return conform(spark.table(name), CLAIMS)


def registry_table(spark: SparkSession, name: str) -> DataFrame:
    return conform(spark.table(name), REGISTRY)
