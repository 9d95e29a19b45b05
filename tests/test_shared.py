"""Landing of the derived tables in the shared folder."""

from __future__ import annotations

import os
import shutil
from collections import Counter

import pytest

from claimhound.plans.catalog import queries, run
from claimhound.sources import shared
from claimhound.sources.derived import SOURCE_TABLES, derive_claims, table_path


def test_landed_claims_equal_derived_claims(spark, sf_dir):
    landed = shared.load_claims(spark, sf_dir)
    derived = derive_claims(spark, sf_dir)
    assert landed.dtypes == derived.dtypes
    assert Counter(landed.collect()) == Counter(derived.collect())


def test_tables_are_landed_once_and_spread(spark, sf_dir):
    first = shared.claims_path(spark, sf_dir)
    assert shared.claims_path(spark, sf_dir) == first
    assert len(spark.read.parquet(first).inputFiles()) == spark.sparkContext.defaultParallelism


@pytest.fixture
def copied(sf_dir, tmp_path):
    for name in SOURCE_TABLES:
        shutil.copyfile(table_path(sf_dir, name), table_path(str(tmp_path), name))
    return str(tmp_path)


def test_replaced_source_data_is_noticed(spark, sf_dir, copied):
    before = shared.load_claims(spark, copied).count()
    half = spark.read.parquet(table_path(sf_dir, "lineitem")).filter("l_orderkey % 2 = 0").toPandas()
    half.to_parquet(table_path(copied, "lineitem"), coerce_timestamps="us")
    assert 0 < shared.load_claims(spark, copied).count() == len(half) < before


def test_a_file_added_below_a_sub_folder_is_noticed(spark, sf_dir, copied):
    lines, source = table_path(copied, "lineitem"), table_path(sf_dir, "lineitem")
    os.remove(lines)
    os.makedirs(f"{lines}/k=0")
    shutil.copyfile(source, f"{lines}/k=0/a.parquet")
    assert shared.load_claims(spark, copied).count() == 6000
    again = shared.claims_path(spark, copied)
    assert shared.claims_path(spark, copied) == again
    shutil.copyfile(source, f"{lines}/k=0/b.parquet")
    assert shared.load_claims(spark, copied).count() == 12000


def test_loading_leaves_the_session_as_it_was(spark, copied):
    before = dict(spark.conf.getAll)
    shared.load_claims(spark, copied)
    shared.load_registry(spark, copied)
    assert dict(spark.conf.getAll) == before


def test_a_folder_set_at_run_time_wins(spark, monkeypatch, tmp_path):
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "getCheckpointDir", lambda self: f"file://{tmp_path}/run-time")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "file:///other")
    assert shared.shared_folder(spark).startswith(f"file://{tmp_path}/run-time/claimhound/")


def test_configured_folder_is_used(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(
        type(spark.conf), "get", lambda self, key, default=None: f"file://{tmp_path}"
    )
    assert shared.shared_folder(spark).startswith(f"file://{tmp_path}/claimhound/")


def test_building_a_plan_starts_no_job_and_leaves_no_folder(spark, sf_dir, monkeypatch):
    claims, registry = shared.load_claims(spark, sf_dir), shared.load_registry(spark, sf_dir)
    monkeypatch.setattr(shared, "shared_folder", lambda spark: pytest.fail("asked for a folder"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "plans only")
    try:
        # rings are found in rounds, each of which is written
        for name in set(queries()) - {"x01_streamed_scores", "q08b_fraud_rings"}:
            run(name, claims, registry)
        assert not tracker.getJobIdsForGroup("built")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plans_read_claims_no_more_often_than_their_branches(spark, sf_dir):
    """Rank histogram, outlier limits and peer means reuse the shuffle of the rows they come from."""
    claims, registry = shared.load_claims(spark, sf_dir), shared.load_registry(spark, sf_dir)
    for name, most in (("q04a_provider_scorecard", 2), ("q08c_billing_outliers", 2), ("r06_peer_benchmark", 1)):
        df = run(name, claims, registry)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = [x for x in text.splitlines() if "FileScan" in x and "Billed_Amount" in x]
        assert 0 < len(lines) <= most, (name, len(lines))


def test_dropped_tables_are_landed_again(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}/own")
    first = shared.claims_path(spark, sf_dir)
    shared.drop_tables(spark)
    assert not list(tmp_path.iterdir())
    again = shared.claims_path(spark, sf_dir)
    assert again != first and spark.read.parquet(again).count() == 6000


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    found = 0
    while files.hasNext():
        found += files.next().getName().startswith("shuffle_")
    return found


def test_landing_keeps_no_shuffle_files_and_is_compressed_well(spark, copied):
    before = shuffle_files(spark)
    path = shared.claims_path(spark, copied)
    assert shuffle_files(spark) <= before
    assert all(".zstd." in f for f in spark.read.parquet(path).inputFiles())


def test_a_setting_holds_inside_only(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    for before in ("3", None):
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
        was = spark.conf.get(key)
        with pytest.raises(ValueError), shared.setting(spark, key, "9"):
            assert spark.conf.get(key) == "9"
            raise ValueError
        assert spark.conf.get(key) == was
