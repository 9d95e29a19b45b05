"""Phrase counts against plain counting, scores against integers, the query against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

from claimhound.llm import collocations as c
from claimhound.llm.collocations import OP12_SQL, collocations, op12_prefix_free, parse, phrase_counts
from compare import differences, duck


def pieces(text):
    low = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows, m):
    out = Counter()
    for text, lang in rows:
        for ws in pieces(text):
            out.update((lang or "und", " ".join(ws[i : i + m])) for i in range(len(ws) - m + 1))
    return out


def plain(rows, max_words=3, min_count=10, share=50, top=2000):
    f = Counter()
    for m in range(1, max_words + 1):
        f += plain_counts(rows, m)
    cand = {k: a for k, a in f.items() if a >= min_count and " " in k[1]}
    n = Counter()
    for (lang, p), a in f.items():
        n[lang] += a if " " not in p else 0
    out = []
    for (lang, p), a in cand.items():
        ws = p.split(" ")
        cuts = []
        for k in range(1, len(ws)):
            l, r = f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        if not any(g == lang and len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= share * a for (g, q), b in cand.items()):
            out.append((lang, p, a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def rows(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "d-e", "f'g", "h", "東京", "\x00", "\xa0x", "i j"] + [f"w{i}" for i in range(30)]
    gaps = [" "] * 8 + ["  ", "\t", " \t ", ". ", ", ", "\n", ";", "\x0b", "!?", " :\r\n"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))
        out.append((text, rng.choice(["en", "EN", "fr", None])))
    return out + out[: n // 3] + [(None, "en"), ("", None), (" \t.,", "fr"), ("the " * 5000, "en"), ("a b c. " * 40, "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 7, "x") for t, g in rows], "text string, lang string, n int, phrase string")


def test_counts_inside_distinct_chunks_are_those_of_the_texts(spark, monkeypatch):
    data = rows(300, 1)
    dictionary = parse(frame(spark, data)).cache()
    n_chunks = dictionary.agg({"n": "sum"}).first()[0]
    assert dictionary.count() < n_chunks  # copies are parsed alike
    for m in (1, 2, 3):
        found = {(r.lang, r.phrase): r.n for r in phrase_counts(dictionary, m).collect()}
        assert found == dict(plain_counts(data, m))


def test_frequent_phrases_pass_the_filter_of_their_ends(spark):
    data = rows(200, 2)
    dictionary = parse(frame(spark, data), max_words=4)
    shorter = phrase_counts(dictionary, 2).where("n >= 5")
    found = {(r.lang, r.phrase): r.n for r in phrase_counts(dictionary, 3, shorter).where("n >= 5").collect()}
    assert found == {k: n for k, n in plain_counts(data, 3).items() if n >= 5}


def test_collocations_equal_plain_ones(spark):
    data = rows(250, 3)
    assert got(collocations(frame(spark, data))) == plain(data)
    assert got(collocations(frame(spark, data), max_words=4, min_count=4, share=70, top=5)) == plain(data, 4, 4, 70, 5)
    assert got(collocations(frame(spark, data), max_words=2, min_count=3)) == plain(data, 2, 3)


def test_large_counts_stay_exact(spark):
    f = spark.createDataFrame
    cand = f([("en", "a b", 2, 3_000_000_000_001), ("en", "a b c", 3, 2_000_000_000_003)], "lang string, phrase string, m int, a long")
    counts = f([("en", "a", 9_000_000_000_007), ("en", "b", 5_000_000_000_009), ("en", "c", 7_000_000_000_001),
                ("en", "a b", 3_000_000_000_001), ("en", "b c", 4_000_000_000_003)], "lang string, phrase string, n long")
    scored = {r.phrase: r.score for r in c._scored(cand, counts).collect()}
    a, b = 3_000_000_000_001, 2_000_000_000_003
    assert scored["a b"] == 10**6 * a * a // (9_000_000_000_007 * 5_000_000_000_009)
    assert scored["a b c"] == min(10**6 * b * b // (9_000_000_000_007 * 4_000_000_000_003), 10**6 * b * b // (a * 7_000_000_000_001))


def test_chunks_are_bounded_and_cut_alike():
    import numpy as np

    text = ("same " * 3000 + "other words follow here. ").encode()
    data = np.frombuffer(text * 2, dtype=np.uint8)
    strings, own, _ = c._chunked(data, np.array([0, len(text), 2 * len(text)]), 3)
    assert own.max() <= c.MOST_WORDS and own.sum() == 2 * 3004
    half = len(strings) // 2
    assert strings[:half].to_pylist() == strings[half:].to_pylist()


def test_an_empty_table_gives_no_rows(spark):
    assert collocations(frame(spark, rows(1, 1)).limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    df = op12_prefix_free(spark, sf_dir)
    assert not differences(df, duck(sf_dir), OP12_SQL)
    assert df.count() > 0
