"""Distinct counts from merged sketches, on odd rows, over refreshes, and against their bound."""

from __future__ import annotations

import pytest
from compare import differences, duck
from pyspark.sql import functions as F
from rows import claims

from claimhound.plans.catalog import queries
from claimhound.plans.oracle import oracle_sql
from claimhound.sources import sketches
from claimhound.sources.partials import Partials
from claimhound.sources.shared import load_claims


def test_query_equals_its_sql(spark, sf_dir):
    name = "x06_sketched_counts"
    assert not differences(queries()[name](spark, sf_dir), duck(sf_dir), oracle_sql()[name])


def test_estimates_of_many_patients_stay_within_the_bound(spark):
    """A hot insurer, 300,000 patients over eight quarters; merged quarters count a patient once."""
    rows = spark.range(600_000).select(
        (F.col("id") % 300_000).alias("Patient_ID"),
        (F.col("id") % 700).alias("Provider_ID"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("I"), F.col("id") % 5)).otherwise("hot").alias("Insurer"),
        (2021 + F.col("id") % 2).cast("int").alias("Claim_Year"),
        F.concat(F.lit("Q"), 1 + F.col("id") % 4).alias("Claim_Quarter"),
    )
    partials = sketches.sketch_partials(rows)
    for by in (sketches.GROUP, ["Insurer"], ["Claim_Year", "Claim_Quarter"]):
        found = sketches.checked(partials, rows, by).collect()
        assert len(found) == rows.select(*by).distinct().count()
        assert all(r.Patients_In_Bound == r.Providers_In_Bound == 1 for r in found)
    whole = sketches.estimated(partials, []).first()
    assert abs(whole.Patients - 300_000) <= 300_000 * sketches.BOUND
    assert whole.Patients != 300_000  # an estimate, not a count in disguise


def test_an_estimate_out_of_bound_fails(spark):
    rows = claims(spark, *[{"Patient_ID": k} for k in range(100)])
    fewer = sketches.sketch_partials(rows.where("Patient_ID < 60"))
    assert [r.Patients_In_Bound for r in sketches.checked(fewer, rows).collect()] == [0]
    none = sketches.sketch_partials(rows.where("false"))
    assert [r.Patients_In_Bound for r in sketches.checked(none, rows).collect()] == [0]


def test_odd_rows(spark):
    rows = claims(
        spark,
        {"Patient_ID": None, "Provider_ID": None},
        {"Patient_ID": 1, "Provider_ID": 1, "Insurer": None},
        {"Patient_ID": 1, "Provider_ID": 2, "Insurer": None},
        {"Patient_ID": 1, "Provider_ID": 2, "Claim_Year": None, "Claim_Quarter": None},
    )
    found = {(r[0], r[1]): tuple(r[2:]) for r in sketches.checked(sketches.sketch_partials(rows), rows).collect()}
    assert found == {(2022, "Acme"): (0, 0, 1, 1), (2022, None): (1, 2, 1, 1), (None, "Acme"): (1, 1, 1, 1)}
    assert sketches.checked(sketches.sketch_partials(rows.limit(0)), rows.limit(0)).count() == 0


def test_a_refresh_reads_new_files_only(spark, sf_dir, tmp_path):
    source, store = str(tmp_path / "claims"), str(tmp_path / "sketches")
    all_claims = load_claims(spark, sf_dir)
    all_claims.where("Claim_Year <= 2022").write.parquet(source)
    partials = Partials(spark, source, store, sketches.sketch_partials)
    assert partials.refresh() > 0 and partials.refresh() == 0
    all_claims.where("Claim_Year > 2022").write.mode("append").parquet(source)
    assert partials.refresh() > 0
    answer = sketches.estimated(partials.rows())
    assert set(answer.inputFiles()) and not any(source in f for f in answer.inputFiles())
    whole = sketches.estimated(sketches.sketch_partials(all_claims))
    got, want = ({tuple(r[:2]): r[2:] for r in df.collect()} for df in (answer, whole))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=sketches.BOUND) for k in want)
