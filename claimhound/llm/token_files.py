"""Token-ID / binary output (op2): one wavelet matrix per shard.

Documents are dealt by ranges of doc_id, sorted within each range, encoded,
ended by an end id and packed into shards of about ``SHARD_TOKENS`` ids. Each
shard is one file holding one row: its place (part, shard), its counts, and the
bytes described in ``wavelet.py``, from which ``wavelet.Shard`` reads tokens,
counts and occurrences. Shards never grow with the table; their number does.

Cases: a null text is empty and gives the end id alone; a null doc_id comes
first and is kept apart by a flag; equal doc_ids stay in one shard order, sorted
by a hash of their text; an empty table gives no shard; other columns are not
read. One text longer than a shard makes a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimhound.llm.encode import WORD_BPE, encoder
from claimhound.llm.staging import new_path, table
from claimhound.llm.wavelet import Shard, pack
from claimhound.llm.words import pieces, utf8

END_ID = 2
SHARD_TOKENS = 1 << 21
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 2 << 20

FILES = "part int, shard int, docs long, tokens long, null_ids long, payload binary"
INDEX = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, size: int):
    """Ids with end ids, ids per document, and the documents' ids, piece by piece."""
    encode = encoder(tokenizer).encode
    for batch in batches:
        texts, doc_ids = batch.column("text"), batch.column("doc_id")
        _, offsets = utf8(texts)
        for a, b in pieces(offsets, size):
            ids, n = encode(texts.slice(a, b - a))
            ends = np.cumsum(n + 1)
            out = np.full(len(ids) + len(n), end_id, dtype=np.uint32)
            inside = np.ones(len(out), dtype=bool)
            inside[ends - 1] = False
            out[inside] = ids
            yield out, n + 1, doc_ids.slice(a, b - a)


def write_shards(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str = WORD_BPE,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode ``docs`` (doc_id, text) and write their shards below ``path``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            doc_ids = pa.concat_arrays([x[2] for x in held])
            payload = pack(ids, doc_ids.fill_null(0).to_numpy(), n)
            row = [part, number, len(n), len(ids), doc_ids.null_count, payload]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names
            )

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["part", "shard", "docs", "tokens", "null_ids", "payload"]
        for found in _encoded(batches, tokenizer, end_id, min(TEXT_BYTES, shard_tokens)):
            held.append(found)
            size += len(found[0])
            if size >= shard_tokens:
                yield flush()
                number, held, size = number + 1, [], 0
        if held:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (
        texts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(shards, FILES)
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .parquet(path)
    )


def read_shards(spark, path: str) -> DataFrame:
    """The shards below ``path``: part, shard, docs, tokens, null_ids, payload."""
    return spark.read.schema(FILES).parquet(path)


def document_index(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    Shards are numbered within parts and parts in the order of doc_id, so the
    ids before a shard are a sum over parts and one over the part's shards.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["payload"])
                raw, n = shard.ids().astype("<u4").view(np.uint8), shard.lengths
                ends = np.cumsum(n)
                crc = [
                    zlib.crc32(raw[4 * a : 4 * b])
                    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)
                ]
                nulls = np.arange(len(n)) < r["null_ids"]
                columns = [
                    pa.array(np.full(len(n), r["part"], dtype=np.int32)),
                    pa.array(np.full(len(n), r["shard"], dtype=np.int32)),
                    pa.array(shard.doc_ids, mask=nulls),
                    pa.array(ends - n),
                    pa.array(n),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"]
    sizes = shards.groupBy("part", "shard").agg(F.sum("tokens").alias("tokens"))
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.sum("in_part").over(before).alias("parts_before"))
    earlier = Window.partitionBy("part").orderBy("shard")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "shard", F.sum("tokens").over(earlier).alias("shards_before"))
    base = sizes.join(parts, "part").select(
        "part",
        "shard",
        (F.coalesce("parts_before", F.lit(0)) + F.coalesce("shards_before", F.lit(0))).alias(
            "base"
        ),
    )
    index = shards.select("part", "shard", "null_ids", "payload").mapInArrow(rows, INDEX)
    return index.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def wavelet_tokens(docs: DataFrame, **options) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and index them from the files."""
    path = new_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, **options)
    return document_index(read_shards(docs.sparkSession, path))


def op2_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    return wavelet_tokens(table(spark, sf_dir, "documents"))
