"""Token counts (op4): the exact histogram of encoded lengths and its suffix sums.

Every whole text is encoded; a task counts its lengths before anything is
shuffled, so what moves is one row per different length and task. From the
suffix sums follow the totals, every quantile, and what any context limit keeps.
Sums run within blocks of lengths first and over blocks then, so no task sorts
the histogram as a whole. The query writes the histogram once, so that the texts
are encoded once for both sums.

Cases: a null or empty text has the length 0 and is counted; repeated rows
count each; an empty table has an empty histogram, nothing under any limit and
null quantiles; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.llm.encode import WORD_BPE, encoder
from claimhound.llm.staging import staged, table
from claimhound.llm.words import pieces, utf8

TEXT_BYTES = 2 << 20
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """n_tokens, n_docs: how many texts of ``docs`` have which encoded length."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer).encode, np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0)
            _, offsets = utf8(texts)
            for a, b in pieces(offsets, TEXT_BYTES):
                found = np.bincount(encode(texts.slice(a, b - a))[1], minlength=len(seen))
                found[: len(seen)] += seen
                seen = found
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=names)

    names = ["n_tokens", "n_docs"]
    texts = docs.select(F.col("text").cast("string"))
    each = texts.mapInArrow(counts, "n_tokens long, n_docs long")
    return each.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length, also: docs_at_least, tokens_at_least, truncated_tokens, share_up_to, docs, tokens.

    ``truncated_tokens`` is what all texts keep if each is cut at n_tokens;
    ``share_up_to`` the share of texts that are no longer, so n_tokens is the
    quantile of every share above the next shorter length's.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    rows = rows.withColumn("in_tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    blocks = rows.groupBy("block").agg(
        F.sum("n_docs").alias("b_docs"), F.sum("in_tokens").alias("b_tokens")
    )
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(every).alias("docs"),
        F.sum("b_tokens").over(every).alias("tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    down = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(down) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("in_tokens").over(down) + F.col("tokens_after")).alias("tokens_at_least"),
        "docs",
        "tokens",
    )
    kept = F.col("tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    up_to = (F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")
    return out.withColumn("truncated_tokens", kept).withColumn("share_up_to", up_to)


def _answers(sums: DataFrame, name: str, answers: Sequence[tuple]) -> DataFrame:
    """One pass over ``sums``: a row for each of ``answers`` (asked value, aggregate), at least one."""
    rows = [F.struct(F.lit(asked).alias(name), found.alias("found")) for asked, found in answers]
    return sums.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, tokens kept, docs_cut, for any limits, from ``suffix_sums``.

    Read from one stored row, that of the least length above the limit: every
    text of at least this length keeps the limit, all others keep all. Above
    the greatest length nothing is cut.
    """
    answers = []
    for c in sorted({int(c) for c in limits}):
        row = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
        above = F.min(F.when(F.col("n_tokens") > c, row))
        lost = above["tokens_at_least"] - F.lit(c) * above["docs_at_least"]
        kept = F.max("tokens") - F.coalesce(lost, F.lit(0))
        found = F.struct(
            F.coalesce(kept, F.lit(0)).alias("tokens"),
            F.coalesce(above["docs_at_least"], F.lit(0)).alias("docs_cut"),
        )
        answers.append((c, found))
    rows = _answers(sums, "context_limit", answers)
    return rows.select(F.col("context_limit").cast("long"), "found.*")


def length_quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of texts does not exceed."""
    up_to = F.col("docs") - F.col("docs_at_least") + F.col("n_docs")
    answers = [
        (q, F.min(F.when(up_to >= F.lit(q) * F.col("docs"), F.col("n_tokens"))))
        for q in sorted({float(q) for q in shares})
    ]
    rows = _answers(sums, "share", answers)
    return rows.select(F.col("share").cast("double"), F.col("found").alias("n_tokens"))


def op4_length_histogram(spark, sf_dir: str) -> DataFrame:
    found = length_histogram(table(spark, sf_dir, "documents"))
    return suffix_sums(staged(found, "length-histogram"))
