from __future__ import annotations

import itertools
import random
import re

import numpy as np

from claimhound.llm.decontamination import (
    SEEDS,
    Places, best_overlap, diagonals, most_agreeing, op7_spaced_seeds, overlaps, without_overlaps,
)

DOC = "doc_id long, text string, doc_key long, row int"
ITEM = "item_id long, text string, words int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], DOC)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], ITEM)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def test_query_equals_brute_force(spark, sf_dir):
    """On these tables passages are verbatim, so any shared ten words tell them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    grams = {}
    for r in items:
        w = words(r.text)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(r.item_id)
    want = set()
    for r in docs:
        w = words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    got = op7_spaced_seeds(spark, sf_dir).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_same >= 10 and r.n_same >= 0.8 * r.n_words for r in got)


def test_substitutions_are_tolerated(spark):
    rng = random.Random(5)
    item = [f"i{k}" for k in range(40)]
    rows = []
    for i in range(60):
        copy = list(item)
        for k in rng.sample(range(40), 6):
            copy[k] = f"s{rng.random()}"
        rows.append((i, " ".join(f"f{rng.random()}" for _ in range(30)) + " " + " ".join(copy).upper()))
    rows += [(100 + i, " ".join(rng.sample(item, 40))) for i in range(20)]
    bench = items_of(spark, [(1, " ".join(item))])
    found = {r.doc_id: r for r in overlaps(docs_of(spark, rows), bench).collect()}
    assert set(range(60)) <= set(found) and not any(k >= 100 for k in found)
    assert all(r.doc_start - r.item_start == 30 for r in found.values())


def best_by_brute_force(same):
    """Agreeing words and length of the best stretch, over all stretches."""
    sums = np.concatenate(([0], np.cumsum(same)))
    each = [(int(sums[b] - sums[a]), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1)]
    n, length = max(x for x in each if 5 * x[0] >= -4 * x[1])
    return n, -length


def test_most_agreeing_equals_brute_force():
    rng = np.random.default_rng(3)
    for k in range(300):
        same = rng.random(rng.integers(12, 61)) >= rng.uniform(0.01, 0.2) * (1 + k % 3)
        start, end, n = most_agreeing(same)
        assert (n, end - start) == best_by_brute_force(same) and n == same[start:end].sum()
    assert most_agreeing(np.zeros(7, bool)) == most_agreeing(np.zeros(0, bool)) == (0, 0, 0)
    assert most_agreeing(np.arange(50) % 5 != 4) == (0, 49, 40)
    assert most_agreeing(np.arange(15) % 5 != 2) == (0, 15, 12)  # exactly 0.8
    assert most_agreeing(np.array([0, 1, 1, 1, 1, 0], bool)) == (1, 5, 4)


def test_replaced_words_do_not_shorten_a_stretch(spark):
    """Copies alike by 80 % or more with few agreeing words between replaced ones, and random ones."""
    rng = random.Random(8)
    shapes = [[8, 4], [9, 4], [4, 4, 4], [4] * 10]
    masks = [[j for n in s for j in [1] * n + [0]][:-1] for s in shapes]
    for n in range(12, 61):
        gone = set(rng.sample(range(n), rng.randint(1, n // 5)))
        masks.append([int(k not in gone) for k in range(n)])
    items, rows = [], []
    for i, mask in enumerate(masks):
        item = [f"w{i}x{k}" for k in range(len(mask))]
        items.append((i, " ".join(item)))
        copy = [w if same else f"s{k}y{i}" for k, (w, same) in enumerate(zip(item, mask, strict=True))]
        rows.append((i, " ".join(["before"] * 5 + copy + ["after"] * 5)))
    want = {}
    for i, mask in enumerate(masks):
        n, length = best_by_brute_force(np.array([0, *mask, 0], bool))
        if n >= 10:
            want[i, i] = (n, length)
    found = overlaps(docs_of(spark, rows), items_of(spark, items)).collect()
    assert len(want) == len(masks)
    assert {(r.doc_id, r.item_id): (r.n_same, r.n_words) for r in found} == want


def test_short_items(spark):
    """Every way to replace words of an item of up to 11 words while 80 % agree, and one word more."""
    items, rows, want = [], [], set()
    for n in range(1, 12):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in (c for r in range(n // 5 + 2) for c in itertools.combinations(range(n), r)):
            copy = [f"s{k}" if k in gone else w for k, w in enumerate(item)]
            doc = len(rows)
            rows.append((doc, " ".join(["before", *copy, "after"])))
            inner = np.array([k not in gone for k in range(n)])
            agreeing, _ = best_by_brute_force(inner) if inner.any() else (0, 0)
            if agreeing >= min(10, -(-4 * n // 5)):
                want.add((doc, n))
    rows += [(len(rows), "w1x0 between " * 300), (len(rows) + 1, "w2x1 w2x0 w3x0 w3x1")]
    want.add((len(rows) - 2, 1))
    found = overlaps(docs_of(spark, rows), items_of(spark, items)).collect()
    assert len(found) == len(want) and {(r.doc_id, r.item_id) for r in found} == want
    assert {n for _, n in want} == set(range(1, 12))
    assert all(r.n_same >= 0.8 * r.n_words for r in found)


def test_odd_rows_and_tables(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, None), (2, ""), (None, passage), (3, passage), (3, passage), (4, "other words " * 500), (5, "alpha beta gamma delta epsilon zeta")]
    bench = items_of(spark, [(1, passage), (1, passage), (None, passage), (2, None), (3, "only four words here"), (4, "alpha beta gamma delta epsilon")])
    found = overlaps(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (None, 3) for i in (1, None, 4)} | {(5, 4)}
    kept = without_overlaps(docs_of(spark, rows), bench)
    assert kept.columns == DOC.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    for d, b in ((rows, []), ([], [(1, passage)]), ([], [])):
        assert overlaps(docs_of(spark, d), items_of(spark, b)).count() == 0
        assert without_overlaps(docs_of(spark, d), items_of(spark, b)).count() == len(d)


def test_diagonals_equal_brute_force(monkeypatch):
    """Texts of few different words, so that hashes repeat; marks in small and large portions."""
    rng = np.random.default_rng(6)
    for k in range(60):
        monkeypatch.setattr("claimhound.llm.decontamination.MARKS", int(rng.integers(1, 40)))
        doc = rng.integers(1, 2 + k % 3, rng.integers(5, 60)).astype(np.uint64)
        item = rng.integers(1, 2 + k % 3, rng.integers(11, 30)).astype(np.uint64)
        want = {
            i - j
            for seed in SEEDS
            for i in range(len(doc) - len(seed) + 1)
            for j in range(len(item) - len(seed) + 1)
            if all(doc[i + x] == item[j + x] for x, bit in enumerate(seed) if bit == "1")
        }
        used = range(len(SEEDS))
        got = diagonals(Places(doc, used), Places(item, used), len(doc), len(item))
        assert got.tolist() == sorted(want)
        best = best_overlap(doc, item, got)
        each = [most_agreeing(doc[max(d, 0) : len(item) + d] == item[max(-d, 0) : len(doc) - d])[2] for d in want]
        assert best[0] == max(each, default=0)


def test_long_repetitive_texts(spark):
    """One word 200,000 times, and two in turn, against items of 2,000 words; no pair of places is a row."""
    one, two = "same " * 2000, "left right " * 1000
    rows = [(1, "same " * 200_000), (2, "left right " * 100_000), (3, "left right other " * 60_000)]
    found = overlaps(docs_of(spark, rows), items_of(spark, [(1, one), (2, two)])).collect()
    assert {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_words, r.n_same) for r in found} == {
        (1, 1): (0, 0, 2000, 2000),
        (2, 2): (0, 0, 2000, 2000),
    }
