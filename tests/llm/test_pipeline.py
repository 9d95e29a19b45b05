from __future__ import annotations

import os

import corpus_pipeline
from test_op6_jaccard import brute
from test_op7_decontamination import words

import __spark_entry__ as contract
from claimhound.llm.staging import staged, table
from claimhound.sources.shared import shared_folder

SF = "/root/testdata/sf0.01"


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in contract.queries()


def test_stages_keep_what_they_must(spark):
    docs = table(spark, SF, "documents")
    columns, grams = docs.columns, set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and docs.dtypes == before.dtypes
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert kept[name].keys() <= {r.doc_id for r in before.collect()}
        before = docs
    groups = brute(sorted(kept["toxicity"].items()))
    assert set(kept["near_duplicates"]) == {i for i, _, first in groups if i == first}
    bad = {i for i, t in kept["near_duplicates"].items() if any(tuple(w[k : k + 10]) in grams for w in [words(t)] for k in range(len(w) - 9))}
    assert bad and set(kept["decontamination"]) == set(kept["near_duplicates"]) - bad
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = tokens.orderBy("start").collect()
    assert len(rows) == docs.count()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_run_on_odd_rows(spark, tmp_path):
    """Whole run, with null ids and texts, repeats, a very long text and columns named like inner ones."""
    source = "doc_id long, text string, lang string, source string, n_chars long, id string, hash long, row int, h double, text_hash string, score string, mix_key int"
    item = " ".join(f"bench{k}" for k in range(40))
    own = [" ".join(f"d{k}w{j}" for j in range(80)) for k in range(6)]
    long = " ".join(f"l{k % 99_991}" for k in range(300_000))
    texts = [(1, own[0]), (2, own[0] + " more"), (None, own[0]), (None, own[1]), (None, own[1]), (3, own[2]), (3, own[2]), (3, own[3])]
    texts += [(4, f"{own[4]} {item} end"), (5, long), (6, long), (7, ""), (8, None), (None, None), (9, own[5])]
    rows = [(i, t, None, "s", 1, "x", 2, 3, 0.5, "y", "z", 4) for i, t in texts]
    spark.createDataFrame(rows, source).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {n.split("-")[0] for n in set(os.listdir(folder)) - before}
    assert left == {"corpus", "token"}
    ids = {r.doc_id for r in got}
    assert ids <= {1, None, 3, 5, 7, 8, 9} and len(got) >= 1
    docs = table(spark, str(tmp_path), "documents")
    kept = staged(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)), "odd")
    assert kept.dtypes == docs.dtypes
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, kept, str(tmp_path)).collect()), key=str)
    want = [(1, own[0]), (None, own[1]), (3, own[2]), (3, own[3]), (5, long), (7, ""), (8, None), (None, None), (9, own[5])]
    assert found == sorted(want, key=str)
