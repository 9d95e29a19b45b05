"""Streamed scores equal batch scores, file by file and without repeats."""

from __future__ import annotations

from collections import Counter

from claimhound.operators.queues import score_claims
from claimhound.plans.catalog import queries
from claimhound.sources.shared import claims_path, load_claims, load_registry, shared_folder
from claimhound.streaming.scoring import claims_stream, scored_stream, start_scoring


def test_stream_equals_batch_over_several_batches_and_a_restart(spark, sf_dir, tmp_path):
    registry = load_registry(spark, sf_dir)
    sink, log = str(tmp_path / "sink"), str(tmp_path / "log")

    def run():
        source = claims_stream(spark, claims_path(spark, sf_dir), files_per_batch=3)
        query = start_scoring(source, registry, sink, log)
        query.awaitTermination()
        return len(query.recentProgress)

    assert run() > 1
    batch = score_claims(load_claims(spark, sf_dir), registry)
    expected = Counter(batch.collect())
    assert Counter(spark.read.schema(batch.schema).parquet(sink).collect()) == expected
    run()
    assert Counter(spark.read.schema(batch.schema).parquet(sink).collect()) == expected


def test_the_registered_query_takes_several_batches_and_leaves_no_log(spark, sf_dir):
    df = queries()["x01_streamed_scores"](spark, sf_dir)
    sink = df.inputFiles()[0].rsplit("/", 1)[0]

    def names(folder):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        return [s.getPath().getName() for s in found]

    assert {"0", "1"} <= set(names(f"{sink}/_spark_metadata"))  # a file per micro-batch
    assert not any(name.startswith("scored-log") for name in names(shared_folder(spark)))


def test_own_paths_and_a_lasting_trigger(spark, sf_dir, tmp_path):
    sink, log = str(tmp_path / "sink"), str(tmp_path / "log")
    df = scored_stream(spark, sf_dir, files_per_batch=2, sink=sink, checkpoint=log)
    assert df.count() > 0 and (tmp_path / "log" / "commits").exists()
    source = claims_stream(spark, claims_path(spark, sf_dir), bytes_per_batch=40_000)
    query = start_scoring(source, load_registry(spark, sf_dir), str(tmp_path / "s2"), str(tmp_path / "l2"), every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive and len(query.recentProgress) > 1
    finally:
        query.stop()
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "s2")).count() == df.count()
