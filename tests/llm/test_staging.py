"""Tables written for a later step."""

from __future__ import annotations

from test_shared import shuffle_files

from claimhound.llm import staging
from claimhound.sources.shared import CLEANUP


def test_what_a_write_shuffles_goes_with_it(spark, tmp_path):
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    rows = spark.range(1000).repartition(5, "id").groupBy("id").count()
    found = staging.written(rows, str(tmp_path / "t"))
    assert shuffle_files(spark) <= before
    assert found.count() == 1000
    assert spark.conf.get(CLEANUP, None) == was
