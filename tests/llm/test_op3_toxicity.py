from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from claimhound.llm.toxicity import (
    BUCKET_BITS, NGRAMS, STRIDE, TABLES, WINDOW, Model, bag, in_training, op3_subword_toxicity, toxicity_model, toxicity_scores,
    train, training_sample, windows, without_toxic,
)
from claimhound.llm.words import hashes, utf8


def corpus(n, seed, bad=("idiot", "moron", "worthless")):
    rng = random.Random(seed)
    syllables = "an the or in re ti ou ea st nd er on".split()
    out = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        if i % 2:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words), i % 2))
    return out


def test_learns_and_generalises_to_misspellings():
    texts, labels = zip(*corpus(500, 1), strict=True)
    model = train(list(texts), list(labels))
    for bad in (("idiot", "moron"), ("idiott", "moronn", "worthles")):
        held, truth = zip(*corpus(200, 2, bad), strict=True)
        scores = model.scores(*utf8(pa.array(held)))
        assert np.mean((scores >= 0.7) == np.array(truth, bool)) > 0.9


def test_scores_do_not_depend_on_batches_and_follow_the_windows():
    texts = [t for t, _ in corpus(60, 3)] + ["", " \n", "one", "a  b\tc" * 50]
    rng = np.random.default_rng(0)
    model = Model(rng.normal(0, 1, 1 << BUCKET_BITS).astype(np.float32), -0.5)
    together = model.logits(*utf8(pa.array(texts)))
    alone = [model.logits(*utf8(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)
    assert together[60] == together[61] == -0.5


def test_ngrams_stay_within_words_and_repeats_count_once():
    b = bag(*utf8(pa.array(["ab Ab cd", "cd"])))
    assert len(b.starts) == 3 and b.first.tolist() == [0, 2, 3]
    texts = sum(len(p) for p, _ in b.grams)
    assert texts == 4 * (2 + 1)  # two trigrams and the word between its marks, four times


def test_windows_cover_every_word():
    start, end, text = windows(np.array([0, 0, 3, 30]), 10, 5)
    assert text.tolist() == [1, 2, 2, 2, 2, 2] and end.tolist()[-1] == 30
    assert set(range(30)) == {w for a, b in zip(start, end, strict=True) for w in range(a, b)}


def test_query_on_the_table(spark, sf_dir):
    rows = op3_subword_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus(300, 4))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    one = toxicity_model(docs, labels)
    flipped = labels.withColumn("toxic", labels.toxic.bitwiseXOR((~in_training(labels.doc_id)).cast("int")))
    two = toxicity_model(docs, flipped)
    assert np.array_equal(one.bucket_scores, two.bucket_scores) and one.bias == two.bias


def test_odd_rows_and_tables(spark):
    model = Model(np.zeros(1 << BUCKET_BITS, np.float32), -1.0)
    rows = [(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = toxicity_scores(df, model)
    assert found.columns == ["doc_id", "text", "score", "predicted"] and found.count() == 4
    kept = without_toxic(df, model)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert toxicity_scores(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert max(r.score for r in toxicity_scores(df, toxicity_model(df, none)).collect()) < 1e-9
    only = spark.createDataFrame([(1, 1, 1)], none.schema)
    assert toxicity_model(df, only).scores(*utf8(pa.array(["a", ""]))).min() > 0.99
    wordless = train(["", " ", None, ""], [1, 0, 0, 0])
    assert np.allclose(wordless.scores(*utf8(pa.array(["", "word"]))), 0.25)


def test_sample_is_taken_from_usable_rows(spark):
    """Labels of documents that are absent or too long take no room, and repeats are one row."""
    usable = [i for i in range(4000) if i % 10 in (3, 4)]
    rows = [(i, f"text {i}") for i in usable] + [(i, "long " * 50) for i in range(4000) if i % 10 in (5, 6)]
    rows += [(usable[0], f"text {usable[0]}")] * 300 + [(usable[1], "another text")] * 300 + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4000)], "doc_id long, quality int, toxic int")
    learnable = {r.doc_id for r in labels.where(in_training(labels.doc_id)).collect()} & set(usable)

    def sample(*bounds):
        found = training_sample(docs, labels, *bounds).collect()
        return [r.text for r in found], [r.toxic for r in found]

    texts, toxic = sample(120, 150, 100, 100_000)
    assert len(texts) == len(set(texts)) == 270 and sum(toxic) == 120
    assert all(t == "another text" or int(t.split()[1]) in learnable for t in texts)
    few, _ = sample(120, 150, 100, 1000)
    assert set(few) < set(texts) and 900 < sum(map(len, few)) <= 1000
    texts, toxic = sample(10_000, 10_000, 100, 10**6)
    more = ["another text"] * (usable[1] in learnable)
    assert sorted(texts) == sorted([f"text {i}" for i in learnable] + more)


def plain_buckets(word):
    """Of a word: its n-grams between boundary marks, one by one, and itself."""
    raw, out = f" {word} ".encode(), []
    for n in NGRAMS:
        for i in range(len(raw) - n + 1):
            h = (sum(int(TABLES[k][raw[i + k]]) for k in range(n)) + n) % 2**32
            out.append((h * 0x9E3779B1) % 2**32 >> (32 - BUCKET_BITS))
    h = int(hashes(np.frombuffer(raw, np.uint8), np.array([1]), np.array([len(raw) - 1]))[0]) % 2**32
    return [*out, (h * 0x9E3779B1) % 2**32 >> (32 - BUCKET_BITS)]


def test_scores_equal_plain_averages_of_ngrams():
    rng = np.random.default_rng(3)
    model = Model(rng.normal(0, 1, 1 << BUCKET_BITS).astype(np.float32), 0.25)
    text = "The quick brown fox jumps over the lazy dog while\televen other été animals a watch it"
    for words in (text.lower().split(), text.lower().split()[:4], ["x"]):
        means, n = [], len(words)
        for a in sorted({*range(0, max(n - WINDOW, 0) + 1, STRIDE), max(n - WINDOW, 0)}):
            found = [k for w in words[a : a + WINDOW] for k in plain_buckets(w)]
            means.append(sum(float(model.bucket_scores[k]) for k in found) / len(found))
        got = model.scores(*utf8(pa.array([" ".join(words)])))[0]
        assert abs(got - 1 / (1 + np.exp(-(max(means) + model.bias)))) < 1e-5
