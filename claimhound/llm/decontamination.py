"""Benchmark decontamination (op7): spaced-seed hashing.

A seed is a mask over consecutive words; it hashes the words at its ones and
ignores those between, so two passages still meet where some words were
replaced. Hashes of all benchmark positions form an index. Every position of
every document is tested against a Bloom filter of fixed size made from the
index; the different hashes that pass are joined with the index itself. The
places of a pair's shared hashes give its diagonals, and along each the stretch
with most agreeing words is verified in which at least ``SIMILARITY`` of the
words agree. A hash goes through the join once for a document or item, however
often it stands there, so a text of one repeated word costs no more rows than
any other; a pair's diagonals are marks in an array as long as its two texts.

Words are as in ``words.py``. Cases: null and empty texts have no words and no
hits; a stretch must agree in ``MIN_WORDS`` words, or in ``SIMILARITY`` of an
item's words if those are fewer, so items of under five words agree as a whole;
items of up to ten words have further seeds, which are not used without them;
repeated documents are one document and repeated items give a row each; an empty
benchmark or table gives no overlaps; extra columns are carried by
``without_overlaps`` and otherwise not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimhound.llm.bloom import bloom_filter, may_hold
from claimhound.llm.staging import staged, table
from claimhound.llm.words import mixed, pieces, utf8, word_hashes

SEEDS = ("11111", "1101101", "11010011", "1100100101")
#: A copy of five to ten words with a fifth of them replaced may hold none of ``SEEDS``, but one of these.
SHORT_SEEDS = ("1111", "10111", "11011", "11101")
#: Under five words, where no word may be replaced, the whole item is the seed.
WHOLE_ITEMS = ("1", "11", "111", "1111")
ANY_LENGTH = 1 << 62
#: Pairs of places of one document and item that are looked at together.
MARKS = 1 << 21
#: Each seed, and the least and most words of the items that it searches.
ALL_SEEDS = (
    *((s, 5, ANY_LENGTH) for s in SEEDS),
    *((s, 5, 10) for s in SHORT_SEEDS),
    *((s, len(s), len(s)) for s in WHOLE_ITEMS),
)
MIN_WORDS = 10
SIMILARITY = 0.8
#: The same as a fraction, so that a stretch of exactly this share is told in integers.
SHARE = Fraction(SIMILARITY).limit_denominator(1000)


def seed_hashes(
    words: np.ndarray, first: np.ndarray, used: Sequence[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each used seed: its number, its hash where it fits in a text, and those places."""
    text_end = np.repeat(first[1:], np.diff(first))
    for k in used:
        seed = ALL_SEEDS[k][0]
        n = len(words) - len(seed) + 1
        if n <= 0:
            continue
        h = np.full(n, k + 1, dtype=np.uint64)
        for j, bit in enumerate(seed):
            if bit == "1":
                h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        fits = np.flatnonzero(np.arange(n) + len(seed) <= text_end[:n])
        yield k, mixed(h[fits]), fits


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words (binary, 8 bytes each) of the items that have words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = word_hashes(*utf8(batch.column("text")))
            each = [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(each, pa.binary())], names=["item_id", "words"]
            )

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    found = items.mapInArrow(rows, "item_id long, words binary")
    found = found.where(F.octet_length("words") > 0)
    return found.withColumn("item_key", F.xxhash64("item_id", "words"))


def seeds_used(items: DataFrame) -> list[int]:
    """The numbers of the seeds that search any of the items, told by at most eleven lengths."""
    n_words = F.least(F.octet_length("words") / 8, F.lit(11)).cast("int").alias("n")
    lengths = [r.n for r in items.select(n_words).distinct().collect()]
    return [k for k, (_, lo, hi) in enumerate(ALL_SEEDS) if any(lo <= n <= hi for n in lengths)]


def first_of_each(h: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each hash of a text stands first in it."""
    text = np.searchsorted(first, places, side="right") - 1
    order = np.lexsort((places, h, text))
    h, text = h[order], text[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return order[new]


def seed_index(items: DataFrame, used: Sequence[int]) -> DataFrame:
    """hash, item_key: every different hash of every item, of the seeds that search it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("words"))
            first = at // 8
            keys = batch.column("item_key").to_numpy()
            for k, h, places in seed_hashes(data.view(np.uint64), first, used):
                item = np.searchsorted(first, places, side="right") - 1
                _, least, most = ALL_SEEDS[k]
                n_words = np.diff(first)[item]
                searched = (n_words >= least) & (n_words <= most)
                h, places = h[searched], places[searched]
                once = first_of_each(h, places, first)
                item = np.searchsorted(first, places[once], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[once].view(np.int64)), pa.array(keys[item])],
                    names=["hash", "item_key"],
                )

    columns = items.select(F.col("words"), "item_key").dropDuplicates(["item_key"])
    return columns.mapInArrow(rows, "hash long, item_key long")


def _doc_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def candidates(docs: DataFrame, filter_bits: np.ndarray, used: Sequence[int]) -> DataFrame:
    """Documents that pass the filter somewhere: doc_key, doc_id, words, hashes (each once)."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def passed(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, found = shared.value, []
        for _, h, places in seed_hashes(words, first, used):
            hit = may_hold(bits, h)
            h, places = h[hit], places[hit]
            once = first_of_each(h, places, first)
            found.append((h[once], places[once]))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(places, kind="stable")
        return h[order], places[order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text").cast(pa.large_string()))
            for a, b in pieces(offsets):
                part = data[offsets[a] : offsets[b]]
                words, first = word_hashes(part, offsets[a : b + 1] - offsets[a])
                h, places = passed(words, first)
                lo, hi = np.searchsorted(places, first[:-1]), np.searchsorted(places, first[1:])
                docs_hit = np.flatnonzero(hi > lo)
                if not len(docs_hit):
                    continue
                ends = np.concatenate(([0], np.cumsum(hi[docs_hit] - lo[docs_hit])))
                each = [words[first[d] : first[d + 1]].tobytes() for d in docs_hit]
                at = pa.array(a + docs_hit)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_key").take(at),
                        batch.column("doc_id").take(at),
                        pa.array(each, pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))),
                    ],
                    names=["doc_key", "doc_id", "words", "hashes"],
                )

    source = docs.select(
        _doc_key().alias("doc_key"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    schema = "doc_key long, doc_id long, words binary, hashes array<long>"
    return source.mapInArrow(rows, schema).dropDuplicates(["doc_key"])


def most_agreeing(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing words of the best stretch along a diagonal.

    Of all stretches in which ``SIMILARITY`` of the words agree, one with most
    agreeing words, the shortest and then the first of these. For every end the
    earliest start counts whose running sum is not above the end's: it is the
    first place where the running minimum is not.
    """
    gain = np.where(same, SHARE.denominator - SHARE.numerator, -SHARE.numerator)
    sums = np.concatenate(([0], np.cumsum(gain)))
    agreeing = np.concatenate(([0], np.cumsum(same)))
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    counts = agreeing - agreeing[starts]
    most = int(counts.max())
    if not most:
        return 0, 0, 0
    places = np.flatnonzero(same)
    ends = np.flatnonzero(counts == most)
    first, last = places[agreeing[starts[ends]]], places[agreeing[ends] - 1]
    k = int(np.argmin(last - first))
    return int(first[k]), int(last[k]) + 1, most


class Places:
    """The hashes of one text in order, each with its places, by seed."""

    def __init__(self, words: np.ndarray, used: Sequence[int]) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, h, at in seed_hashes(words, np.array([0, len(words)]), used):
            order = np.argsort(h, kind="stable")
            self.of[k] = h[order], at[order]


def diagonals(doc: Places, item: Places, n_doc: int, n_item: int) -> np.ndarray:
    """Differences of place, ascending, at which the two texts share a hash.

    Every pair of places is marked in one array of ``n_doc + n_item`` flags,
    at most ``MARKS`` pairs at a time or one place's.
    """
    seen = np.zeros(n_doc + n_item, dtype=bool)
    for k, (h, at) in item.of.items():
        _, least, most = ALL_SEEDS[k]
        if not least <= n_item <= most or k not in doc.of:
            continue
        doc_h, doc_at = doc.of[k]
        lo, hi = np.searchsorted(doc_h, h), np.searchsorted(doc_h, h, side="right")
        hit = np.flatnonzero(hi > lo)
        lo, n, at = lo[hit], hi[hit] - lo[hit], at[hit]
        total, a = np.cumsum(n), 0
        while a < len(n):
            done = int(total[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + MARKS, side="right")))
            each = np.repeat(lo[a:b] - (total[a:b] - n[a:b] - done), n[a:b])
            place = doc_at[each + np.arange(len(each))]
            seen[place - np.repeat(at[a:b], n[a:b]) + n_item] = True
            a = b
    return np.flatnonzero(seen) - n_item


def best_overlap(doc: np.ndarray, item: np.ndarray, found: np.ndarray) -> tuple[int, int, int, int]:
    """Agreeing words, start in both texts and length of the best stretch on any diagonal."""
    best = (0, 0, 0, 0)
    for d in found.tolist():
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        agree = doc[lo + d : hi + d] == item[lo:hi]
        if np.count_nonzero(agree) <= best[0]:
            continue
        start, end, same = most_agreeing(agree)
        if same > best[0]:
            best = (same, lo + d + start, lo + start, end - start)
        if same == len(item):
            break
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and item that share a passage.

    doc_key, doc_id, item_id, doc_start, item_start, n_words, n_same: the best
    stretch, in words; ``n_same`` of its ``n_words`` agree.
    """
    items = staged(benchmark_words(benchmark), "benchmark-words")
    used = seeds_used(items)
    index = staged(seed_index(items, used), "benchmark-seeds")
    found = staged(candidates(docs, bloom_filter(index, "hash"), used), "seed-hits")
    hits = found.select("doc_key", F.explode("hashes").alias("hash"))
    shared = hits.join(index, "hash").select("doc_key", "item_key").distinct()
    pairs = shared.join(found.select("doc_key", "doc_id", "words"), "doc_key").join(
        items.select("item_key", "item_id", F.col("words").alias("item_words")), "item_key"
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc_places = None, None
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                doc = np.frombuffer(r["words"], dtype=np.uint64)
                item = np.frombuffer(r["item_words"], dtype=np.uint64)
                if r["doc_key"] != last:
                    last, doc_places = r["doc_key"], Places(doc, used)
                lines = diagonals(doc_places, Places(item, used), len(doc), len(item))
                best = best_overlap(doc, item, lines)
                if best[0] >= min(min_words, ceil(SHARE * len(item))):
                    rows.append(
                        dict(
                            doc_key=r["doc_key"], doc_id=r["doc_id"], item_id=r["item_id"],
                            doc_start=best[1], item_start=best[2], n_words=best[3], n_same=best[0],
                        )
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    names = ["doc_key", "doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4
    out = pa.schema(list(zip(names, kinds, strict=True)))
    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'int'}" for n, k in zip(names, kinds, strict=True))
    return pairs.select("doc_key", "doc_id", "item_id", "words", "item_words").mapInArrow(verified, schema)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark, columns as they are.

    The keys to drop are written first, so their true size decides how they
    are joined.
    """
    bad = overlaps(docs, benchmark, **options).select(F.col("doc_key").alias("decon_key")).distinct()
    bad = staged(bad, "contaminated")
    rows = docs.select(_doc_key().alias("doc_key"), F.struct("*").alias("row"))
    return rows.join(bad, F.col("doc_key") == F.col("decon_key"), "left_anti").select("row.*")


def op7_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return overlaps(docs, benchmark).drop("doc_key")
