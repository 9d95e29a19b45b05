"""A feed of claims as they are submitted, some of them more than once, replayed in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimhound.sources.schema import CLAIMS
from claimhound.sources.shared import _file_system, _path, new_folder, remove_folder, setting

#: When a claim came in. Days begin at midnight UTC, whatever the session's zone.
SUBMITTED = T.StructField("Submitted", T.TimestampType())
ARRIVALS = T.StructType([*CLAIMS.fields, SUBMITTED])


def with_time(claims: DataFrame, day: Column) -> DataFrame:
    return claims.withColumn("Submitted", F.timestamp_seconds(F.unix_date(day).cast("long") * 86400))


def arrivals(claims: DataFrame) -> DataFrame:
    """Each claim within five days of its date, and every ninth again up to 30 days later."""
    number = F.col("Claim_ID")
    first = with_time(claims, F.date_add("Claim_Date", (number % 5).cast("int")))
    again = claims.where(number % 9 == 0)
    return first.unionByName(with_time(again, F.date_add("Claim_Date", (6 + number % 25).cast("int"))))


def folder(spark: SparkSession, name: str) -> str:
    path = new_folder(spark, name)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path


#: Open files of a task that deals rows to years; with more years than these it sorts its rows.
YEARS_AT_ONCE = "64"


def move_files(spark: SparkSession, source: str, to: str, prefix: str) -> None:
    """The data files of folder ``source`` moved into ``to``, their names behind ``prefix``."""
    path = _path(spark, source)
    fs = _file_system(spark, path)
    fs.mkdirs(_path(spark, to))
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")) and not fs.rename(f.getPath(), _path(spark, f"{to}/{prefix}{name}")):
            raise OSError(f"cannot move {f.getPath()} to {to}")


def replay(rows: DataFrame, feed: str, run: Callable[[], None]) -> None:
    """Append ``rows`` to the folder ``feed`` year by year, and ``run`` after each.

    They are written once, a folder per year whose files then move to the feed.
    A task keeps a file per year open, so it need not sort its rows by year,
    which would hold them all in memory. The order of files within a year is not
    told, so a stream has to allow for a year's disorder. Rows without a time
    come first.
    """
    spark = rows.sparkSession
    path = folder(spark, "by-year")
    year = F.coalesce(F.year("Submitted"), F.lit(0))
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", YEARS_AT_ONCE):
        dealt = rows.withColumn("_year", year)
        dealt.write.option("compression", "zstd").partitionBy("_year").parquet(path)
    folders = [f.getPath().getName() for f in _file_system(spark, _path(spark, path)).listStatus(_path(spark, path))]
    for y in sorted(int(name.partition("=")[2]) for name in folders if name.startswith("_year=")):
        move_files(spark, f"{path}/_year={y}", feed, f"{y}-")
        run()
    remove_folder(spark, path)
