from __future__ import annotations

from collections import Counter

from compare import differences, duck

from claimhound.llm.mixing import OP1_SQL, op1_poisson_mix, poisson_mix, source_rates

DOC = "doc_id long, text string, source string, copy_no int, mix_key string, rate double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", 0.5) for r in rows], DOC)


def test_matches_sql(spark, sf_dir):
    assert differences(op1_poisson_mix(spark, sf_dir), duck(sf_dir), OP1_SQL) == []


def test_output_follows_the_target_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 3 else "small") for i in range(6000)]
    mixed = poisson_mix(frame(spark, rows), {"big": 1.0, "small": 3.0})
    found = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(found["small"] / (found["small"] + found["big"]) - 0.75) < 0.03
    assert abs(sum(found.values()) - 6000) < 300


def test_counts_are_poisson_for_small_and_split_means(spark):
    docs = frame(spark, [(i, "abc", "s") for i in range(3000)])
    for budget in (1.0, 40.0):
        mixed = poisson_mix(docs, budget=budget)
        n = Counter(r.doc_id for r in mixed.select("doc_id").collect())
        counts = [n[i] for i in range(3000)]
        mean = sum(counts) / 3000
        spread = sum((c - mean) ** 2 for c in counts) / 3000
        assert abs(mean - budget) < 0.1 * budget and abs(spread - budget) < 0.15 * budget


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(1, None, None), (None, "same", "a"), (None, "same", "a"), (2, "", "empty"), (3, "abc", "b")] * 4
    mixed = poisson_mix(frame(spark, rows), budget=3.0)
    assert mixed.columns == ["doc_id", "text", "source", "mix_key", "rate", "copy_no"]
    again = Counter(map(tuple, poisson_mix(frame(spark, rows), budget=3.0).collect()))
    assert Counter(map(tuple, mixed.collect())) == again
    plain = poisson_mix(frame(spark, rows), budget=3.0, number_copies=False)
    assert plain.columns == DOC.replace(",", "").split()[::2]
    per = Counter(r.copy_no for r in mixed.where("doc_id IS NULL").collect())
    assert all(n % 8 == 0 for n in per.values())  # equal documents get equal counts


def test_empty_table_and_unweighted_sources(spark):
    assert poisson_mix(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "a", "x"), (2, "b", "y")])
    rates = {r.mix_key: r["mean"] for r in source_rates(docs, {"x": 1.0}).collect()}
    assert rates == {"x": 2.0, "y": 0.0}


def test_no_python_runs(spark, sf_dir):
    plan = op1_poisson_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
