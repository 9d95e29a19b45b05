"""Packing (op13): shortest-pack-first over the histogram of lengths.

Every whole text is encoded where it is read and ended by an end id. Its ids are
windows of the sequence size and a rest, written once to the shared folder with
a number that counts windows of the same length within the writing task. Counts
per task and length give the exact histogram, which has one row per length and
is all that the driver sees, and the rank of every window among those of its
length. The plan (``shortest_first.py``) is made from the histogram alone; its
patterns are joined back to the windows by length and rank. Its size is bounded
by the sequence size, whatever the number of documents, so it goes to all tasks.
Rests are cut only where their pack is taken apart to fill up others; all
sequences together are padded by less than one sequence.

Cases: a null text is empty and is the end id alone; a null doc_id is kept, and
repeated rows are documents of their own; an empty table gives no piece; other
columns are not read; a very long text is many windows and never one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.llm.encode import BYTE_BPE, encoder
from claimhound.llm.shortest_first import Plan
from claimhound.llm.staging import staged, table
from claimhound.llm.words import pieces, utf8

SIZE = 1024
END_ID = 0
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 2 << 20

WINDOWS = "doc_id long, start long, length int, doc_tokens long, part int, number long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def windows(docs: DataFrame, *, size: int = SIZE, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """The ids of ``docs`` (doc_id, text) in windows of ``size`` and a rest, as 16 or 32 bits each.

    ``number`` counts the windows of a length within ``part``.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            _, offsets = utf8(texts)
            for a, b in pieces(offsets, TEXT_BYTES):
                ids, n = encode(texts.slice(a, b - a))
                ends = np.cumsum(n + 1)
                out = np.full(len(ids) + len(n), end_id, dtype=width)
                inside = np.ones(len(out), dtype=bool)
                inside[ends - 1] = False
                out[inside] = ids
                each = -(-(n + 1) // size)
                doc = np.repeat(np.arange(b - a), each)
                start = size * (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each))
                length = np.minimum(size, (n + 1)[doc] - start)
                order = np.argsort(length, kind="stable")
                number = np.empty(len(doc), dtype=np.int64)
                found = np.bincount(length, minlength=size + 1)
                number[order] = np.arange(len(doc)) - np.repeat(np.cumsum(found) - found, found)
                number += seen[length]
                seen += found
                at = np.concatenate(([0], np.cumsum(length))) * out.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(a, b - a).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length.astype(np.int32)),
                        pa.array((n + 1)[doc]),
                        pa.array(np.full(len(doc), part, dtype=np.int32)),
                        pa.array(number),
                        pa.BinaryArray.from_buffers(
                            pa.binary(), len(doc), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)]
                        ),
                    ],
                    names=names,
                )

    width, names = _width(tokenizer), [c.split()[0] for c in WINDOWS.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, WINDOWS)


def _width(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def pack(docs: DataFrame, *, size: int = SIZE, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) and their places in sequences of ``size`` ids.

    Columns: doc_id, start (ids of its document before it), length, ids (little-
    endian unsigned 32 bits each), doc_tokens, sequence_id, offset.
    """
    cut = staged(windows(docs, size=size, tokenizer=tokenizer, end_id=end_id), "windows")
    counts = staged(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "window-counts")
    rows = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``size`` rows
    plan = Plan({r.length: r.n for r in rows}, size)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            window, inner, n, sequence, offset = plan.find(length, rank)
            data, at = utf8(batch.column("ids"))
            one = np.dtype(width).itemsize
            firsts = at[window] // one + inner
            bounds = np.concatenate(([0], np.cumsum(n)))
            ids = data.view(width)[np.repeat(firsts - bounds[:-1], n) + np.arange(bounds[-1])].astype("<u4")
            ids = pa.BinaryArray.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)]
            )
            taken = pa.array(window)
            columns = {
                "doc_id": batch.column("doc_id").take(taken), "start": pa.array(start[window] + inner),
                "length": pa.array(n), "ids": ids, "doc_tokens": batch.column("doc_tokens").take(taken),
                "sequence_id": pa.array(sequence), "offset": pa.array(offset),
            }
            yield pa.RecordBatch.from_pydict(columns)

    width = _width(tokenizer)
    return ranked.select("doc_id", "start", "length", "doc_tokens", "rank", "ids").mapInArrow(placed, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the packed sequences, from the pieces of ``pack``."""
    row = F.struct("offset", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("held"))
    ids = F.expr("aggregate(held, X'', (a, p) -> a || p.ids)")
    return whole.select("sequence_id", F.expr("aggregate(held, 0L, (a, p) -> a + p.length)").alias("n_tokens"), ids.alias("ids"))


def op13_shortest_pack(spark, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"))
    crc = F.crc32("ids").alias("ids_crc32")
    return found.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
