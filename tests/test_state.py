"""Streams with state, replayed batches and refreshed partials against batch answers."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter
from functools import reduce

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from rows import claims

from claimhound.operators import behaviour
from claimhound.operators.queues import score_claims
from claimhound.sources.partials import Partials, quarter_partials, quarters
from claimhound.sources.shared import claims_path, load_claims, load_registry
from claimhound.streaming import replays
from claimhound.streaming.arrivals import with_time
from claimhound.streaming.scoring import claims_stream
from claimhound.streaming.state import STATE, append_to, arrival_stream, first_submissions, late_rows, most_crowded, provider_days

D = dt.date


class Feed:
    """Rows added to a folder, and a stream over it run to the end of what is there."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.make = spark, make
        self.feed, self.sink, self.log = (str(tmp_path / n) for n in ("feed", "sink", "log"))

    def add(self, *changes):
        """Claims of one file; ``on`` is the day they are submitted."""
        rows = [
            with_time(claims(self.spark, {k: v for k, v in c.items() if k != "on"}), F.lit(c["on"]).cast("date"))
            for c in changes
        ]
        reduce(DataFrame.unionByName, rows).coalesce(1).write.mode("append").parquet(self.feed)

    def run(self):
        query = append_to(self.make(arrival_stream(self.spark, self.feed)), self.sink, self.log)
        query.awaitTermination()
        return late_rows(query)

    def read(self, schema):
        return self.spark.read.schema(schema).parquet(self.sink).collect()


def test_repeats_over_batches_and_restarts_come_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: first_submissions(s, "10 days").select("Claim_ID"))
    feed.add({"Claim_ID": 1, "on": "2022-01-01"}, {"Claim_ID": 1, "on": "2022-01-01"}, {"Claim_ID": 2, "on": "2022-01-02"})
    assert feed.run() == 0
    feed.add({"Claim_ID": 1, "on": "2022-01-08"}, {"Claim_ID": 3, "on": "2022-01-03"}, {"Claim_ID": 9, "on": None})
    assert feed.run() == 0  # each run starts anew from the checkpoint
    feed.add({"Claim_ID": 4, "on": "2022-02-10"})
    assert feed.run() == 0
    feed.add({"Claim_ID": 5, "on": "2022-01-04"}, {"Claim_ID": 4, "on": "2022-02-12"}, {"Claim_ID": 6, "on": "2022-02-05"})
    assert feed.run() == 1  # claim 5 comes behind the watermark of 2022-01-31
    assert Counter(r.Claim_ID for r in feed.read("Claim_ID long")) == Counter([1, 2, 3, 4, 6])
    feed.add({"Claim_ID": 1, "on": "2022-02-13"})  # forgotten since
    feed.run()
    assert Counter(r.Claim_ID for r in feed.read("Claim_ID long"))[1] == 2


def test_days_close_behind_the_watermark_and_late_rows_are_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: provider_days(s, "2 days"))
    schema = "day struct<start:timestamp,end:timestamp>, Provider_ID long, Provider_Name string, Specialty string, Claims_That_Day long, Patients_That_Day long, billed decimal(32,2), Fraud_That_Day long"
    day = {"Claim_Date": D(2022, 3, 1), "on": "2022-03-01"}
    feed.add(*[{**day, "Patient_ID": p, "Fraud_Label": (p or 0) % 2} for p in (1, 1, 2, None)])
    assert feed.run() == 0 and feed.read(schema) == []  # still open
    feed.add({**day, "Patient_ID": 3}, {"on": "2022-03-02", "Patient_ID": 1})
    assert feed.run() == 0
    feed.add({"on": "2022-03-08", "Patient_ID": 1})
    assert feed.run() == 0
    found = {r.day.start.day: r for r in feed.read(schema)}
    assert set(found) == {1, 2} and found[1].Claims_That_Day == 5 and found[1].Patients_That_Day == 3
    assert found[1].Fraud_That_Day == 2 and float(found[1].billed) == 500
    feed.add({**day, "Patient_ID": 4}, {"on": "2022-03-07", "Patient_ID": 4})
    assert feed.run() == 1
    assert len(feed.read(schema)) == 2
    busy = most_crowded(spark.read.schema(schema).parquet(feed.sink), min_claims=2).collect()
    assert [(r.Claim_Date, r.Claims_That_Day) for r in busy] == [(D(2022, 3, 1), 5)]


def state_files(log):
    return [os.path.join(d, f) for d, _, names in os.walk(f"{log}/state") for f in names if not f.startswith(".")]


def test_state_is_kept_on_disk_and_old_versions_go(spark, tmp_path):
    """State of all batches was held in the heap before, and files of a hundred batches stayed."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    for name, make in (
        ("claims", lambda s: first_submissions(s, "10 days").select("Claim_ID")),
        ("days", lambda s: provider_days(s, "2 days").select("Provider_ID", "Claims_That_Day")),
    ):
        feed = Feed(spark, tmp_path / name, make)
        for day in range(1, 9):  # a restart each
            feed.add({"Claim_ID": 1, "on": f"2022-03-0{day}"}, {"Claim_ID": 10 + day, "on": f"2022-03-0{day}"})
            assert feed.run() == 0
        files = state_files(feed.log)
        assert any(f.endswith(".zip") for f in files)  # RocksDB's
        assert not any(f.endswith((".delta", ".snapshot")) for f in files)  # those of state in the heap
        offsets = [int(f) for f in os.listdir(f"{feed.log}/offsets") if f.isdigit()]
        assert len(offsets) < 8 <= max(offsets)
        if name == "claims":
            assert sorted(r.Claim_ID for r in feed.read("Claim_ID long")) == [1, *range(11, 19)]
        else:
            rows = feed.read("Provider_ID long, Claims_That_Day long")
            assert [tuple(r) for r in rows] == [(1, 2)] * 5
    assert {key: spark.conf.get(key, None) for key in STATE} == before


def test_a_batch_that_failed_half_way_is_replaced(spark, sf_dir, tmp_path):
    registry, sink, log = load_registry(spark, sf_dir), str(tmp_path / "sink"), str(tmp_path / "log")
    failures = []

    def half(rows, path):
        if path.endswith("batch=1") and not failures:
            failures.append(path)
            replays.replace_folder(rows.limit(max(1, rows.count() // 2)), path)
            raise RuntimeError("lost")
        replays.replace_folder(rows, path)

    def start():
        scored = score_claims(claims_stream(spark, claims_path(spark, sf_dir), files_per_batch=3), registry)
        return replays.start_replacing(scored, sink, log, write=half)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    batch = score_claims(load_claims(spark, sf_dir), registry)
    expected = Counter(batch.collect())
    assert Counter(replays.read_batches(spark, sink, batch).collect()) != expected
    start().awaitTermination()
    assert failures and len(os.listdir(sink)) > 2
    assert Counter(replays.read_batches(spark, sink, batch).collect()) == expected


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_refresh_reads_new_files_only(spark, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    made = []

    def aggregate(rows):
        made.append(rows)
        return quarter_partials(rows)

    partials = Partials(spark, source, store, aggregate)
    os.makedirs(source)
    assert partials.refresh() == 0 and quarters(partials.rows()).count() == 0

    def add(*changes):
        claims(spark, *changes).coalesce(1).write.mode("append").parquet(source)

    def check():
        full = quarters(quarter_partials(spark.read.schema(made[0].schema).parquet(source)))
        merged = quarters(partials.rows())
        assert sorted(merged.collect()) == sorted(full.collect())
        assert source not in plan(merged)  # the source is not read again

    old = {"Claim_Year": 2021, "Claim_Quarter": "Q1"}
    add({**old, "Provider_ID": 1}, {**old, "Provider_ID": 1, "Fraud_Label": 1}, {**old, "Provider_ID": None})
    assert partials.refresh() == 1
    check()
    before = set(os.listdir(source))
    add({**old, "Provider_ID": 2, "Paid_Amount": None}, {**old, "Claim_Quarter": "Q2"})
    made.clear()
    made.append(claims(spark, old))
    assert partials.refresh() == 1
    new = [f for f in os.listdir(source) if f not in before and f.endswith(".parquet")]
    read = [f.rsplit("/", 1)[1] for rows in made[1:] for f in rows.inputFiles()]
    assert read == new
    check()
    assert partials.refresh() == 0
    gone = next(f for f in before if f.endswith(".parquet"))
    os.remove(f"{source}/{gone}")
    check()  # its part no longer counts
    partials.compact()
    assert len([f for f in os.listdir(f"{store}/rows") if f.startswith("part=")]) == 1
    check()


def test_an_unfinished_part_does_not_count(spark, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    claims(spark, {}, {}).coalesce(1).write.parquet(source)
    partials = Partials(spark, source, store, quarter_partials)
    partials.refresh()
    part = os.listdir(f"{store}/rows")[0]
    quarter_partials(claims(spark, {})).write.parquet(f"{store}/rows/part=unfinished")
    assert quarters(partials.rows()).collect()[0].Claims == 2 and part.startswith("part=")


def test_streamed_days_equal_the_batch_analysis(spark, sf_dir):
    from claimhound.plans.catalog import queries

    streamed = queries()["x04_streamed_crowded_days"](spark, sf_dir)
    assert streamed.collect() == behaviour.crowded_days(load_claims(spark, sf_dir)).select(streamed.columns).collect()
