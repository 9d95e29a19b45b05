"""Phrase collocation mining (op12) by prefix-free parsing.

A document is a run of words, with a break where a piece ends. A chunk starts
at the document's first word and at every word whose hash is divisible by
``PERIOD`` (and after ``MOST_WORDS`` words without one), so equal passages are
cut alike wherever they occur. A chunk also holds the words after it that its
last phrases reach into, up to the next break; ``own`` tells how many words are
its own. Equal chunks are one row of the dictionary with their frequency in the
parse. Phrases are counted inside distinct chunks only, weighted by the
frequency, and each belongs to the chunk that owns its first word: phrases in
the overlaps are counted once.

Phrases of m words are counted after those of m-1 words: one that is frequent
has two frequent ends, and a Bloom filter of fixed size, built from the frequent
shorter phrases, drops the others. It has no false negatives and all counts are
of phrases themselves, so the result is exact however full the filter is.

Cases: a null text is empty; a null language is ``und``; a text without words
has no chunk; repeated rows count each; a word that repeats without end is cut
every ``MOST_WORDS`` words; an empty table gives an empty one; other columns are
not read. Counts are exact to 10**15 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimhound.llm.bloom import bloom_filter, may_hold
from claimhound.llm.staging import staged, table
from claimhound.llm.words import hashes, pieces, utf8

PERIOD = 32
MOST_WORDS = 1024
RUN_BYTES = 1 << 20
#: Parts into which a language's phrases are dealt before its best are chosen.
SALTS = 64

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*(ord(c) for c in ".,;:!?"), *range(0x0A, 0x0E)]] = True
SOLID = ~BREAKS
SOLID[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLANK, BREAK = ord(" "), ord("\n")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of the first word of each text."""
    edge = np.ones(len(data) + 1, dtype=bool)
    solid = SOLID[data]
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = solid[at[:-1]]
    starts = at[:-1][word]
    return starts, at[1:][word], np.searchsorted(starts, offsets)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span, spans may overlap."""
    sizes = ends - starts
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    flat = data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.LargeStringArray.from_buffers(
        len(sizes), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)
    ).cast(pa.string())


def _chunked(data: np.ndarray, offsets: np.ndarray, most: int):
    """Chunks of all texts: their strings, own words and text numbers. ``most``: words of a phrase."""
    data = LOWER[data]
    starts, ends, first = _words(data, offsets)
    n = len(starts)
    if not n:
        return None
    breaks = np.concatenate(([0], np.cumsum(BREAKS[data])))
    broken = np.ones(n + 1, dtype=bool)
    broken[1:-1] = breaks[starts[1:]] != breaks[ends[:-1]]
    broken[first] = True
    cut = np.zeros(n, dtype=bool)
    cut[:] = hashes(data, starts, ends) % np.uint64(PERIOD) == 0
    cut[first[first < n]] = True
    place = np.arange(n)
    cut |= (place - np.maximum.accumulate(np.where(cut, place, 0))) % MOST_WORDS == 0
    begin = np.flatnonzero(cut)
    own_end = np.append(begin[1:], n)
    end, joined = own_end.copy(), np.ones(len(begin), dtype=bool)
    for k in range(most - 1):
        joined &= ~broken[np.minimum(own_end + k, n)]
        end += joined
    # the same words, each after one blank or break
    at = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    flat = np.empty(at[-1], dtype=np.uint8)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[:-1]] = False
    flat[inside] = data[SOLID[data]]
    flat[at[:-1]] = np.where(broken[:-1], BREAK, BLANK)
    text = np.searchsorted(first, begin, side="right") - 1
    return _strings(flat, at[begin] + 1, at[end]), own_end - begin, text


def parse(docs: DataFrame, max_words: int = 3) -> DataFrame:
    """The dictionary of ``docs`` (text, lang): lang, own, chunk, n (its frequency)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, RUN_BYTES):
                run = data[offsets[a] : offsets[b]]
                found = _chunked(run, offsets[a : b + 1] - offsets[a], max_words)
                if found is not None:
                    strings, own, text = found
                    langs = batch.column("lang").take(pa.array(a + text))
                    yield pa.RecordBatch.from_arrays(
                        [langs, pa.array(own, pa.int32()), strings], names=["lang", "own", "chunk"]
                    )

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parsed = texts.mapInArrow(chunks, "lang string, own int, chunk string")
    return parsed.groupBy("lang", "own", "chunk").agg(F.count("*").alias("n"))


def _key(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return hashes(data, starts, ends) ^ lang


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    data, offsets = utf8(langs)
    return hashes(data, offsets[:-1], offsets[1:]) if len(data) else np.zeros(len(langs), np.uint64)


def _filter(frequent: DataFrame) -> np.ndarray:
    """A Bloom filter of the phrases in ``frequent`` (lang, phrase)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _lang_hashes(batch.column("lang"))
            data, offsets = utf8(batch.column("phrase"))
            for a, b in pieces(offsets):
                at = offsets[a : b + 1] - offsets[a]
                h = _key(data[offsets[a] : offsets[b]], at[:-1], at[1:], lang[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return bloom_filter(frequent.select("lang", "phrase").mapInArrow(rows, "h long"), "h")


def phrase_counts(dictionary: DataFrame, m: int, shorter: DataFrame | None = None) -> DataFrame:
    """lang, phrase, n: occurrences of the phrases of ``m`` words.

    With ``shorter``, the frequent phrases of m-1 words, phrases with an end
    that is not among them may be missing; all others are counted in full.
    """
    sc = dictionary.sparkSession.sparkContext
    known = sc.broadcast(_filter(shorter)) if shorter is not None else None

    def grams(data, offsets, own, lang) -> tuple:
        starts, ends, first = _words(data, offsets)
        chunk = np.repeat(np.arange(len(own)), np.diff(first))
        place = np.arange(len(starts))
        ok = place - first[chunk] < own[chunk]
        ok &= place + m <= first[chunk + 1]
        at = place[ok]
        # a phrase holds no break: every gap inside it is one blank
        solid = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum((starts > 0) & (data[starts - 1] == BREAK), out=solid[1:])
        at = at[solid[at + m] == solid[at + 1]]
        if known is not None:
            for k in (0, 1):
                h = _key(data, starts[at + k], ends[at + k + m - 2], lang[chunk[at]])
                at = at[may_hold(known.value, h)]
        return _strings(data, starts[at], ends[at + m - 1]), chunk[at]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("chunk"))
            own, freq = batch.column("own").to_numpy(), batch.column("n").to_numpy()
            langs = batch.column("lang").dictionary_encode()
            code, lang = langs.indices.to_numpy(), _lang_hashes(langs.dictionary)
            for a, b in pieces(offsets, RUN_BYTES):
                at = offsets[a : b + 1] - offsets[a]
                run = data[offsets[a] : offsets[b]]
                phrases, chunk = grams(run, at, own[a:b], lang[code[a:b]])
                rows = pa.table([phrases, code[a:b][chunk], freq[a:b][chunk]], names=["phrase", "lang", "n"])
                summed = rows.group_by(["phrase", "lang"]).aggregate([("n", "sum")]).combine_chunks()
                for r in summed.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [langs.dictionary.take(r.column("lang")), r.column("phrase"), r.column("n_sum")],
                        names=["lang", "phrase", "n"],
                    )

    found = dictionary.mapInArrow(counts, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _joined(words: str, start: str, length: str) -> Column:
    return F.expr(f"array_join(slice({words}, {start}, {length}), ' ')")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (lang, phrase, m, a) with l, r, score of their lowest-scoring cut."""
    cuts = candidates.withColumn("words", F.split("phrase", " "))
    cuts = cuts.withColumn("k", F.explode(F.expr("sequence(1, m - 1)")))
    cuts = cuts.select(
        "lang", "phrase", "m", "a", "k", _joined("words", "1", "k").alias("head"),
        _joined("words", "k + 1", "m - k").alias("rest"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = {c: f"CAST({c} AS DECIMAL(15,0))" for c in ("a", "l", "r")}
    score = "CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a}) DIV ({l} * {r})".format(**wide)
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    least = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "m", "a").agg(least)
    return best.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "cut.score")


def _free(candidates: DataFrame, max_words: int, share: int) -> DataFrame:
    """``candidates`` without those that mostly occur inside a longer candidate."""
    longer = candidates.where("m > 2").withColumn("words", F.split("phrase", " "))
    parts = [
        longer.where(f"m > {size}").select(
            "lang", "a", F.explode(F.expr(f"transform(sequence(1, m - {size} + 1), i -> array_join(slice(words, i, {size}), ' '))")).alias("phrase"),
        )
        for size in range(2, max_words)
    ]
    if not parts:
        return candidates
    around = reduce(DataFrame.unionByName, parts).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left")
    return kept.where(f"around IS NULL OR 100 * around < {share} * a").drop("around")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` rows, with their rank; no task sees all rows of a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    salted = salted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return salted.withColumn("rank", rank).where(F.col("rank") <= top).drop("salt", "place")


def collocations(
    docs: DataFrame, *, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000
) -> DataFrame:
    """Each language's best phrases of ``docs`` (text, lang) of 2 to ``max_words`` words.

    A phrase occurs ``min_count`` times at least. Cut into a head and a rest, it
    scores floor(10**6 * a * a / (l * r)); the lowest-scoring cut counts. One
    that lies inside a longer one with ``share`` % of its occurrences is dropped.
    Returns lang, rank, phrase, a, l, r, n (words of the language), score.
    """
    dictionary = staged(parse(docs, max_words), "chunk-dictionary")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    levels: list[DataFrame] = []
    for m in range(1, max_words + 1):
        counted = phrase_counts(dictionary, m, levels[-1] if levels else None)
        frequent = counted.where(F.col("n") >= min_count).withColumn("m", F.lit(m))
        levels.append(staged(frequent, f"phrases-{m}"))
    counts = reduce(DataFrame.unionByName, levels)
    candidates = counts.where("m > 1").select("lang", "phrase", "m", F.col("n").alias("a"))
    kept = _free(_scored(candidates, counts), max_words, share)
    return _best(kept, top).join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op12_prefix_free(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1),
    lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, m, a, ws, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND a >= 10
), scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, h.a AS l, t.a AS r,
    CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a
  FROM f WHERE m = 3 AND a >= 10
), around AS (
  SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.phrase = l.phrase
  WHERE o.most IS NULL OR 100 * o.most < 50 * l.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
