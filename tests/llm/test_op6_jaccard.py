from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimhound.llm import jaccard
from claimhound.llm.components import components
from claimhound.llm.jaccard import near_duplicates, one_of_each, op6_heavy_light_join, similar_in
from claimhound.sources.shared import setting

DOC = "doc_id long, text string, row string, id int"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in lists[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def near_copies(seed, n=160):
    """Chains and stars of edited texts of all sizes, about the threshold."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 9, 12, 14, 30, 60, 200]))
        for _ in range(n // 12):
            base = list(base) if rng.random() < 0.5 else base
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(*d, "r", 1) for d in docs], DOC)


def found(df):
    return sorted(map(tuple, near_duplicates(df).collect()))


@pytest.mark.parametrize("seed, small", [(1, None), (2, 3), (3, 12), (4, 64)])
def test_components_equal_brute_force_for_any_boundary(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(jaccard, "boundary", lambda found: small)
    docs = near_copies(seed)
    assert found(frame(spark, docs)) == brute(docs)


def test_small_blocks_and_one_big_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    rng = random.Random(9)
    base = [f"x{k}" for k in range(120)]
    docs = []
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = f"y{rng.random()}"
        docs.append((i, " ".join(copy)))
    assert found(frame(spark, docs)) == brute(docs)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op6_heavy_light_join(spark, sf_dir).collect())) == brute(docs)


def test_threshold_is_exact():
    def pair(common, more):  # common / (common + more) exactly
        a = np.arange(common + more, dtype=np.uint64)
        return similar_in(np.array([5, 7]), [a, a[:common]], np.zeros(2, int))

    assert pair(4, 1) and pair(80, 20) and not pair(79, 20) and not pair(399, 100)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two"), (None, "lone"), (6, "a b c d e"), (7, "A\nb c d e" + " "), (8, "z " * 3000)]
    got = near_duplicates(frame(spark, rows)).collect()
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == want
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["4", "None"]
    kept = one_of_each(frame(spark, [*rows, (6, "a b c d e")]))
    assert kept.columns == DOC.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.where("doc_id > 0").collect()) == [1, 2, 3, 4, 6, 8]
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["lone"]
    assert near_duplicates(frame(spark, [])).count() == 0 == one_of_each(frame(spark, [])).count()


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path[:-1], path[1:], strict=True)) + [(7, k) for k in range(8, 40)] + [(2, 2), (None, 3), (60, 50), (50, 60)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {k: 100 for k in path} | {k: 7 for k in range(7, 40)} | {50: 50, 60: 50}
    assert components(df.where(F.lit(False))).count() == 0


def test_rows_are_told_apart_by_their_sets(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "b " * 3 + long), (2, long + " tail"), (5, "one other text of its own"), (None, long), (None, long), (0, "c d"), (None, "c d"), (None, ""), (None, None), (9, ""), (9, "")]
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    alike = [(-1, 56, 2), (-1, 56, 2), (2, 57, 2), (5, 59, 2)]
    assert got == sorted([*alike, (5, 2, 5), (-1, 1, 0), (-1, 1, 0), (-1, 0, None), (-1, 0, None), (9, 0, 9), (9, 0, 9)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(frame(spark, rows)).collect()), key=str)
    want = [(2, long + " tail"), (5, "one other text of its own"), (0, "c d"), (None, ""), (None, None), (9, "")]
    assert kept == sorted(want, key=str)


def test_forest_of_many_sets():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sets = []
        for _ in range(40):
            base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else rng.integers(0, 400, 12)
            sets.append(np.unique(np.append(base, rng.integers(0, 400, 1)).astype(np.uint64)))
        side = rng.integers(0, 2, 40) * rng.integers(0, 2)
        want = list(range(40))
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * len(np.union1d(sets[i], sets[j])) and (side[i] != side[j] or not side.any()):
                    want = [want[i] if x == want[j] else x for x in want]
        links = similar_in(np.arange(40), sets, side)
        got = list(range(40))
        for i, j in links:
            assert got[i] != got[j]  # a forest
            got = [got[i] if x == got[j] else x for x in got]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_unrelated_sets_of_a_full_block_take_seconds():
    rng = np.random.default_rng(6)
    sets = list(rng.integers(0, 1 << 62, (260_000, 8)).astype(np.uint64))
    sets[7], sets[200_000] = sets[100_000].copy(), sets[199_999].copy()
    start = time.perf_counter()
    assert len(similar_in(np.arange(len(sets)), sets, np.zeros(len(sets), int))) == 2
    assert time.perf_counter() - start < 30


def test_rows_that_surely_have_no_key_are_not_dealt(spark):
    rows = spark.range(5000).selectExpr("id", "hash(id) AS other", "xxhash64(id) AS h")
    perhaps, apart = jaccard._dealt(rows, rows.where("id % 100 = 0"))
    held, others = ({r.id for r in part.collect()} for part in (perhaps, apart))
    assert not held & others and held | others == set(range(5000))
    assert set(range(0, 5000, 100)) <= held and len(held) < 100


def test_texts_are_dealt_once_to_be_found(spark):
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f h"), (None, "p q r s t u v"), (2, "a b c d e f h")])
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    groups = docs.distinct().selectExpr("0L AS component", "xxhash64(doc_id, text) AS node", "doc_id", "text_hash", "3L AS n")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        plan = jaccard.links_among(docs, groups)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # members, texts, and both together by their group


@pytest.mark.parametrize("few, batch", [(2, 1), (3, 7), (16, 5), (16, 10_000)])
def test_few_and_many_sets_of_a_key_over_batches(spark, monkeypatch, few, batch):
    monkeypatch.setattr(jaccard, "FEW", few)
    docs = near_copies(7, 120)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)):
        assert found(frame(spark, docs)) == brute(docs)


def test_unlike_texts_that_share_keys_are_not_grouped(spark, monkeypatch):
    grouped = []

    def links_among(docs, groups):
        grouped.extend(groups.collect())
        return whole(docs, groups)

    whole = jaccard.links_among
    monkeypatch.setattr(jaccard, "links_among", links_among)
    docs = [(k, " ".join([f"s{k}w{j}" for j in range(8)] + [f"u{k}w{j}" for j in range(40)] + [f"s{k + 1}w{j}" for j in range(8)])) for k in range(60)]
    docs += [(60, docs[7][1] + " end")]
    assert found(frame(spark, docs)) == brute(docs)
    assert {r.doc_id for r in grouped} == {7, 60}  # all 61 before


def test_bits_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(8)
    pairs = []
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 62, rng.integers(0, 150)).astype(np.uint64)))
        pairs += [(a, b)] if len(b) else []
    apart = jaccard.bits_apart(*([jaccard.parity_bits(x) for x in side] for side in zip(*pairs, strict=True)))
    one_only = np.array([len(np.setxor1d(a, b)) for a, b in pairs])
    assert (apart <= one_only).all()
    alike = [jaccard.similar_in(np.arange(2), [a, b], np.zeros(2, int)) != [] for a, b in pairs]
    most = jaccard._difference(np.array([len(a) + len(b) for a, b in pairs]))
    assert any(alike) and (one_only[alike] <= most[alike]).all()
    assert len(jaccard.bits_apart([], [])) == 0
    for n in (4, 20, 64, 300, 1025, 20_000):
        a, b = ([jaccard.parity_bits(rng.integers(0, 1 << 62, n).astype(np.uint64)) for _ in range(20)] for _ in range(2))
        assert (jaccard.bits_apart(a, b) > jaccard._difference(np.array([2 * n]))).all()  # unlike sets
