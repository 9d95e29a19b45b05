"""Replays of a feed: every row once, whole, and written once."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from rows import claims

from claimhound.streaming import arrivals


def test_each_year_arrives_whole_and_is_written_once(spark, tmp_path, monkeypatch):
    feed, seen, writes = str(tmp_path / "feed"), [], []
    dates = [dt.date(1969, 5, 1), dt.date(2021, 1, 1), dt.date(2021, 12, 31), dt.date(2022, 6, 1), None]
    rows = claims(spark, *[{"Claim_Date": d} for d in dates * 3]).repartition(4)
    rows = arrivals.with_time(rows, F.col("Claim_Date"))
    key, write = "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        writes.append((path, spark.conf.get(key)))
        return write(self, path, *args, **kwargs)

    def now():
        return spark.read.schema(rows.schema).parquet(feed)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    before = spark.conf.get(key)
    arrivals.replay(rows, feed, lambda: seen.append((now().count(), now().agg(F.max("Claim_Date")).first()[0])))
    assert seen == [(3, None), (6, dates[0]), (12, dates[2]), (15, dates[3])]
    assert Counter(now().collect()) == Counter(rows.collect())
    assert len(writes) == 1 and int(writes[0][1]) > len(seen)  # no sort by year, no second copy
    assert spark.conf.get(key) == before


def test_nothing_to_replay(spark, tmp_path):
    rows = arrivals.with_time(claims(spark, {}).limit(0), F.col("Claim_Date"))
    runs = []
    arrivals.replay(rows, str(tmp_path / "feed"), lambda: runs.append(1))
    assert not runs
