"""Toxicity (op3): subword-bag embeddings averaged into a linear softmax.

Each word, between boundary marks, gives its character n-grams of 3 to 5 bytes
and itself, hashed into buckets that each have an embedding. A window of words
is the average of its embeddings; a linear softmax reads it. Embeddings and
softmax are trained jointly in numpy. An unseen misspelling shares n-grams, and
so vectors, with the words it resembles.

A document's score is its worst window's, so a remark in a long text is not
averaged away. Labels are of documents, so training is by multiple instances:
every window of a clean document is clean; of a toxic one, first all its windows
count as toxic, then those that the model itself finds worst.

Only the training sample is bounded (``toxic_rows`` and ``clean_rows``, the first
by a hash, among labelled documents of at most ``train_chars`` characters, and
``total_chars`` of them all). One task learns from it and hands the driver the
model, which has a fixed size. Scoring is one pass over all texts without a
shuffle: as everything is linear, an embedding and the softmax
fold into one number per bucket, and windows are differences of running sums.

Cases: null and empty texts have no window and get the score of the bias alone;
a null doc_id cannot be labelled and is scored like any other; repeated rows are
scored each; with labels of one kind only, every score is that share; without
any label it is 0; an empty table gives an empty one; extra columns are kept
by ``toxicity_scores`` unless named like its own, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from claimhound.llm.staging import staged, table
from claimhound.llm.words import IS_SPACE, hashes, pieces, spans, utf8

BUCKET_BITS = 18
NGRAMS = (3, 4, 5)
#: Words of a window, and from one to the next.
WINDOW, STRIDE = 10, 5
#: Bytes of training text whose windows are laid out at a time.
TRAIN_BYTES = 1 << 18
THRESHOLD = 0.7
SEED = 7


def _tables() -> np.ndarray:
    """Random values by place in the n-gram and byte; case of A-Z apart, white space alike."""
    values = np.random.default_rng(SEED).integers(0, 1 << 32, (max(NGRAMS), 256), dtype=np.uint32)
    values[:, ord("A") : ord("Z") + 1] = values[:, ord("a") : ord("z") + 1]
    values[:, IS_SPACE] = values[:, [ord(" ")]]
    return values


TABLES = _tables()


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Bag:
    """Texts between boundary marks: the buckets that start at each byte, and the words."""

    size: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # of each n: places, buckets
    starts: np.ndarray  # of each word, but for those that repeat the word before
    ends: np.ndarray
    words: np.ndarray  # bucket of each word
    first: np.ndarray  # number of each text's first word


def bag(data: np.ndarray, offsets: np.ndarray) -> Bag:
    marked = np.insert(data, offsets, ord(" "))
    at = offsets + np.arange(len(offsets))
    starts, ends, first = spans(marked, at)
    h = hashes(marked, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][first[:-1] < len(new)]] = True
    first = np.concatenate(([0], np.cumsum(new)))[first]
    starts, ends, h = starts[new], ends[new], h[new]
    words = _buckets(h.astype(np.uint32))
    spaces = np.concatenate(([0], np.cumsum(IS_SPACE[marked], dtype=np.int32)))
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    h = None
    for n in range(1, max(NGRAMS) + 1):
        part = TABLES[n - 1][marked[n - 1 :]]
        h = part if h is None else h[: len(part)] + part
        if n in NGRAMS and len(h):
            inner = spaces[n - 1 : n - 1 + len(h)] == spaces[1 : 1 + len(h)]
            places = np.flatnonzero(inner)
            grams.append((places, _buckets(h[places] + np.uint32(n))))
    return Bag(len(marked), grams, starts, ends, words, first)


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, dtype=x.dtype), np.cumsum(x)))


def _of_words(at_bytes: np.ndarray, b: Bag) -> np.ndarray:
    """Sums over each word and the mark before it; n-grams that leave a word are not there."""
    sums = _running(at_bytes)
    return sums[b.ends] - sums[b.starts - 1]


def windows(first: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and last word's end of each window, and each window's text.

    The last window of a text ends with it; a text without words has none.
    """
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // stride)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * stride, np.maximum(n[text] - size, 0))
    end = np.minimum(start + size, n[text])
    return first[text] + start, first[text] + end, text


@dataclass
class Model:
    bucket_scores: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -500, 500)))

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        b = bag(data, offsets)
        logits = np.full(len(offsets) - 1, self.bias)
        if len(b.starts):
            total, count = np.zeros(b.size), np.zeros(b.size, dtype=np.int32)
            for places, buckets in b.grams:
                total[places] += self.bucket_scores[buckets]
                count[places] += 1
            total, count = (
                _running(_of_words(x, b) + y)
                for x, y in ((total, self.bucket_scores[b.words]), (count, 1))
            )
            start, end, text = windows(b.first, WINDOW, STRIDE)
            each = (total[end] - total[start]) / (count[end] - count[start])
            at = np.flatnonzero(np.diff(text, prepend=-1))
            logits[text[at]] = self.bias + np.maximum.reduceat(each, at)
        return logits


def _windows_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A run of texts at a time: buckets of all windows in order, their number per window, its text."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    for lo, hi in pieces(offsets, TRAIN_BYTES):
        b = bag(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(b.starts):
            continue
        places = np.concatenate([p for p, _ in b.grams] + [b.starts])
        buckets = np.concatenate([x for _, x in b.grams] + [b.words])
        word = np.searchsorted(b.starts, places + 1, side="right") - 1
        word[-len(b.starts) :] = np.arange(len(b.starts))
        inside = (word >= 0) & (places < b.ends[word])
        order = np.argsort(word[inside], kind="stable")
        word, buckets = word[inside][order], buckets[inside][order].astype(np.int32)
        start, end, text = windows(b.first, WINDOW, WINDOW)
        a, z = np.searchsorted(word, start), np.searchsorted(word, end)
        n = z - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield buckets[at], n, text + lo


def _instances(texts: list[str], min_texts: int) -> tuple:
    """Places of known buckets for all windows in order, windows' sizes and texts, known buckets.

    A bucket is known if ``min_texts`` texts use it; the others' place is the
    one after the last. Two passes, so that only the result is ever held.
    """
    sizes, owner = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    used_by = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for buckets, n, text in _windows_of(texts):
        each = np.unique(np.repeat(text, n) << BUCKET_BITS | buckets)
        used_by += np.bincount(each & ((1 << BUCKET_BITS) - 1), minlength=len(used_by))
        sizes.append(n)
        owner.append(text)
    known = np.flatnonzero(used_by >= min_texts)
    place = np.full(1 << BUCKET_BITS, len(known), dtype=np.int32)
    place[known] = np.arange(len(known))
    sizes, filled = np.concatenate(sizes), 0
    flat = np.empty(int(sizes.sum()), dtype=np.int32)
    for buckets, _, _ in _windows_of(texts):
        flat[filled : filled + len(buckets)] = place[buckets]
        filled += len(buckets)
    return flat, sizes, np.concatenate(owner), known


def train(
    texts: list[str],
    toxic: list[int],
    *,
    dimensions: int = 8,
    epochs: int = 3,
    batch: int = 256,
    rate: float = 0.01,
    scale: float = 40.0,
    min_texts: int = 3,
) -> Model:
    """Embeddings and softmax together, by Adam on windows.

    Buckets that fewer than ``min_texts`` texts use stay without a vector. A
    fourth of the texts is kept out; on their worst windows, the logits are
    mapped to the probability of a toxic document.
    """
    label = np.asarray(toxic, dtype=np.int64)
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 500.0 if share else -500.0)
    flat, sizes, owner, known = _instances(texts, min_texts)
    if not len(owner):  # no text has a word
        odds = float(np.log(label.mean() / (1 - label.mean())))
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), odds)
    at = np.concatenate(([0], np.cumsum(sizes)))
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 1e-3, (len(known) + 1, dimensions)).astype(np.float32)
    vectors[-1] = 0
    soft = rng.normal(0, 0.5, (dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (vectors, soft, bias)]
    kept_out, steps = np.zeros(len(label), dtype=bool), 0
    for k in (0, 1):
        kept_out[np.flatnonzero(label == k)[::4]] = len(label) >= 40

    def forward(rows: np.ndarray) -> tuple:
        n = sizes[rows]
        begin = np.cumsum(n) - n
        buckets = flat[np.repeat(at[rows] - begin, n) + np.arange(n.sum())]
        mean = scale * np.add.reduceat(vectors[buckets], begin, axis=0) / n[:, None]
        logits = mean @ soft + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return n, buckets, mean, p / p.sum(axis=1, keepdims=True)

    def toxic_share(rows: np.ndarray) -> np.ndarray:
        parts = np.array_split(rows, 1 + len(rows) // 2048)
        return np.concatenate([forward(r)[3][:, 1] for r in parts if len(r)])

    y, learned = label[owner], np.flatnonzero(~kept_out[owner])
    used = learned
    for epoch in range(epochs):
        if epoch:
            found = np.zeros(len(owner))
            found[learned] = toxic_share(learned)
            worst = np.zeros(len(label))
            np.maximum.at(worst, owner, found)
            likely = found >= np.minimum(worst[owner], 0.5)
            used = learned[(y[learned] == 0) | likely[learned]]
        for rows in np.array_split(rng.permutation(used), 1 + len(used) // batch):
            n, buckets, mean, error = forward(rows)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = np.repeat((scale * (error @ soft.T) / n[:, None]).astype(np.float32), n, axis=0)
            to_vectors = np.stack(
                [np.bincount(buckets, back[:, d], len(vectors)) for d in range(dimensions)], 1
            )
            to_vectors[-1] = 0
            steps += 1
            for (p, m, v), g in zip(state, (to_vectors, mean.T @ error, error.sum(0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    toward = (soft[:, 1] - soft[:, 0]).astype(np.float64)
    scores = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
    scores[known] = scale * (vectors[:-1] @ toward)
    model = Model(scores, float(bias[1] - bias[0]))
    return _calibrated(model, texts, label, kept_out)


def _calibrated(model: Model, texts: list[str], label: np.ndarray, kept_out: np.ndarray) -> Model:
    """Logits of documents, scaled and shifted by a logistic fit on the texts kept out."""
    if len(set(label[kept_out].tolist())) < 2:
        return model
    data, offsets = utf8(pa.array([t for t, x in zip(texts, kept_out, strict=True) if x]))
    x = np.concatenate(
        [
            model.logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for a, b in pieces(offsets)
        ]
    )
    middle, spread = x.mean(), x.std() + 1e-9
    x, y, w = (x - middle) / spread, label[kept_out], np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):  # Newton's steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        w -= np.linalg.solve(hessian, design.T @ (p - y) + 0.05 * w)
    slope = max(float(w[0]), 1e-6) / spread
    return Model(
        (model.bucket_scores * slope).astype(np.float32),
        slope * (model.bias - middle) + float(w[1]),
    )


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 != 1


def training_sample(
    docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int, train_chars: int, total_chars: int
) -> DataFrame:
    """doc_id, text, toxic: at most so many texts of each label, the first by a hash of doc_id.

    Labels meet the ids of the short documents before they are limited, so that
    those of other documents take no room in the sample. Repeats of one doc_id
    and text are one row. Each label's texts hold half of ``total_chars`` at
    most. Only the keys of labelled documents are written; the sampled ones are
    a table of at most so many rows, so it is broadcast.
    """
    known = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select("doc_id", "text").where(
        in_training(F.col("doc_id")) & (F.length("text") <= train_chars)
    )
    short = short.withColumn("text_key", F.xxhash64("text"))
    chars = F.length("text").alias("chars")
    usable = short.select("doc_id", "text_key", chars).distinct().join(known, "doc_id")
    usable = staged(usable, "labelled-documents")
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text_key")]
    so_far = F.sum("chars").over(Window.orderBy(*order))  # over the limited rows alone
    wanted = [
        usable.where(F.col("toxic") == k).orderBy(*order).limit(n)
        .withColumn("so_far", so_far).where(F.col("so_far") <= total_chars // 2)
        for k, n in enumerate((clean_rows, toxic_rows))
    ]
    picked = wanted[0].unionByName(wanted[1]).select("doc_id", "text_key", "toxic")
    rows = short.join(F.broadcast(picked), ["doc_id", "text_key"])
    return rows.select("doc_id", "text", "toxic").distinct()


def toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    *,
    toxic_rows: int = 1200,
    clean_rows: int = 2200,
    train_chars: int = 20_000,
    total_chars: int = 24_000_000,
) -> Model:
    """Learnt by one task from the bounded sample; the driver gets the model alone."""

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)
        )
        model = train([r[1] for r in rows], [r[2] for r in rows])
        scores = model.bucket_scores.astype("<f4").tobytes()
        yield pa.RecordBatch.from_pydict({"scores": [scores], "bias": pa.array([model.bias], pa.float64())})

    sample = training_sample(docs, labels, toxic_rows, clean_rows, train_chars, total_chars)
    found = sample.repartition(1).mapInArrow(learnt, "scores binary, bias double").collect()
    if not found:  # no sampled row, so no task
        return train([], [])
    return Model(np.frombuffer(bytes(found[0].scores), dtype="<f4"), found[0].bias)


def _scored(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    data, offsets = utf8(batch.column("text").cast(pa.large_string()))
    parts = [
        model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for a, b in pieces(offsets)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score (double) and predicted (int)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scored(batch, shared.value)
            more = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                batch.columns + more, names=[*batch.schema.names, "score", "predicted"]
            )

    source = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    more = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return source.mapInArrow(scored, StructType(source.schema.fields + more))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, shared.value) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op3_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))

    return toxicity_scores(docs, model).select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted"
    )
