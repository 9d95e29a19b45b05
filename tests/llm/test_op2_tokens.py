from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from claimhound.llm.encode import Encoder
from claimhound.llm.staging import new_path
from claimhound.llm.token_files import op2_wavelet_tokens, read_shards, wavelet_tokens, write_shards
from claimhound.llm.wavelet import Shard, pack

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
HARD = [
    "It's DON'T 12ab34, x<|endoftext|>y <|startoftext|>", "", "  \t\x0b\x1c  ", "éa ,́b",
    "…,,..!?'s'", "Étion çouİ K ß東京 １２ ½", "a\x00b c\x85d", "Of%%% athe*** ", "ſt 'RE can't", "x" * 5000,
]


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts(spark, sf_dir):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids, n = Encoder().encode(pa.array([*texts, None]))
    assert n.tolist() == [len(whole(t)) for t in [*texts, None]]
    assert ids.tolist() == [i for t in texts for i in whole(t)]


def test_encoder_forgets_when_full(monkeypatch):
    monkeypatch.setattr("claimhound.llm.encode.MOST_KEPT_PIECES", 3)
    encoder = Encoder()
    for _ in range(2):
        ids, _ = encoder.encode(pa.array(["one two three four", "five one six"]))
        assert ids.tolist() == whole("one two three four five one six")


def test_wavelet_answers_as_the_sequence():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49408, 3000), np.zeros(700, int), np.zeros(0, int), rng.integers(0, 70000, 1025)):
        ids = ids.astype(np.uint32)
        shard = Shard(pack(ids, np.array([5]), np.array([len(ids)])))
        assert np.array_equal(shard.ids(), ids)
        for i in range(0, len(ids), 97):
            token = int(ids[i])
            assert shard.access(i) == token
            places = np.flatnonzero(ids == token)
            assert shard.count(token) == len(places)
            assert shard.count(token, 10, i) == ((places >= 10) & (places < i)).sum() or i < 10
            assert [shard.locate(token, k) for k in range(min(4, len(places)))] == places[:4].tolist()
        assert shard.count(123456) == 0


def expected(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*whole(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_encoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = op2_wavelet_tokens(spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(sorted(map(tuple, docs)))


def test_small_shards_nulls_and_repeats(spark):
    rows = [(3, "b"), (1, None), (None, "first"), (2, ""), (3, "b"), (7, "long " * 900)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, part int")
    got = wavelet_tokens(df, shard_tokens=4).collect()
    want = expected([rows[2], rows[1], rows[3], rows[0], rows[4], rows[5]])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert wavelet_tokens(df.limit(0)).count() == 0


def test_a_shard_is_one_file_and_answers_alone(spark):
    df = spark.createDataFrame([(i, "the cat sat") for i in range(50)], "doc_id long, text string")
    path = new_path(spark, "test-shards")
    write_shards(df, path, shard_tokens=40)
    shards = read_shards(spark, path)
    assert len(shards.inputFiles()) == shards.count() > 4
    cat = whole("cat")[0]
    assert sum(Shard(r.payload).count(cat) for r in shards.collect()) == 50
