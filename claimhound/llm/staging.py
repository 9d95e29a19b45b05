"""Tables written to the shared folder and read back, to cut lineage.

The folder is the cluster's ``spark.checkpoint.dir``; a local session without
that setting gets a temporary one. A cluster without it is an error here: its
executors would have nowhere to share a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from claimhound.sources.shared import CLEANUP, new_folder, remove_folder, setting

#: Folders of tables staged in each step that has begun, the innermost last.
_steps: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = new_folder(spark, name)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path


def written(df: DataFrame, path: str, **options) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read back; what the write shuffled is removed."""
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    if _steps:
        _steps[-1].append(path)
    return written(df, path, **options)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end: what needs them must be written by then."""
    _steps.append([])
    try:
        yield
    finally:
        for path in _steps.pop():
            remove_folder(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
