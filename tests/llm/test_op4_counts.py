from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from claimhound.llm.token_counts import (
    length_histogram, length_quantiles, op4_length_histogram, suffix_sums, truncated_totals,
)

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def lengths(texts):
    return [len(PLAIN.encode(t or "", add_special_tokens=False).ids) for t in texts]


def check(sums, n):
    rows = {r.n_tokens: r for r in sums.collect()}
    count = Counter(n)
    assert {k: r.n_docs for k, r in rows.items()} == count
    for k, r in rows.items():
        assert r.docs_at_least == sum(x >= k for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.truncated_tokens == sum(min(x, k) for x in n)
        assert (r.docs, r.tokens) == (len(n), sum(n))
        assert r.share_up_to == sum(x <= k for x in n) / len(n)


def test_query_equals_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op4_length_histogram(spark, sf_dir), lengths(texts))


def test_limits_and_quantiles_over_several_blocks(spark):
    texts = [None, "", "cat", "cat", "cat " * 1023, "cat " * 1024, "cat " * 5000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n_docs int")
    sums, n = suffix_sums(length_histogram(df)), lengths(texts)
    check(sums, n)
    got = {r.context_limit: (r.tokens, r.docs_cut) for r in truncated_totals(sums, [0, 1, 700, 1024, 9999]).collect()}
    assert got == {c: (sum(min(x, c) for x in n), sum(x > c for x in n)) for c in (0, 1, 700, 1024, 9999)}
    q = {r.share: r.n_tokens for r in length_quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert q == {s: min(x for x in n if sum(y <= x for y in n) >= s * len(n)) for s in (0.0, 0.5, 0.9, 1.0)}
    empty = suffix_sums(length_histogram(df.limit(0)))
    assert empty.count() == 0
    assert [tuple(r) for r in truncated_totals(empty, [5]).collect()] == [(5, 0, 0)]
    assert [tuple(r) for r in length_quantiles(empty, [0.5]).collect()] == [(0.5, None)]


def test_limits_read_suffix_sums_without_a_join(spark, sf_dir, capsys):
    """The query's own rows answer limits and quantiles, and its texts are encoded before its plan begins."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, sums = lengths(texts), op4_length_histogram(spark, sf_dir)
    limits, shares = [0, 3, 64, 511, 512, 2048, max(n), max(n) + 1], [0.01, 0.25, 0.5, 0.99, 1.0]
    totals, quantiles = truncated_totals(sums, limits), length_quantiles(sums, shares)
    assert {r.context_limit: (r.tokens, r.docs_cut) for r in totals.collect()} == {
        c: (sum(min(x, c) for x in n), sum(x > c for x in n)) for c in limits
    }
    assert {r.share: r.n_tokens for r in quantiles.collect()} == {
        s: min(x for x in n if sum(y <= x for y in n) >= s * len(n)) for s in shares
    }
    sums.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    totals.explain()
    assert "NestedLoop" not in capsys.readouterr().out
