"""Plans against packing one item at a time, pieces against whole encodings."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimhound.llm import encode, packing
from claimhound.llm.packing import op13_shortest_pack, pack, sequences
from claimhound.llm.shortest_first import Plan, place, taken_apart

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


def one_by_one(histogram, size):
    """Spaces left by packing single items, longest first, into the shortest pack with room."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            packs.sort()
            if packs and packs[0] + length <= size:
                packs[0] += length
            else:
                packs.append(length)
    return Counter(packs)


def histograms():
    rng = random.Random(4)
    for size in (8, 16, 64):
        for _ in range(25):
            yield {rng.randrange(1, size + 1): rng.choice([1, 1, 2, 3, 17]) for _ in range(rng.randrange(1, 14))}, size
    yield {}, 16
    yield {1: 1}, 16
    yield {5: 1000}, 8


@pytest.mark.parametrize("case", list(histograms()))
def test_plans(case):
    histogram, size = case
    patterns = place(histogram, size)
    fills = Counter()
    for p in patterns:
        fills[p.filled] += p.count
    assert fills == one_by_one(histogram, size)
    seen = Counter()
    for p in patterns:
        assert 0 < p.filled <= size and p.count > 0
        seen.update((s.length, s.rank + j) for s in p.slots for j in range(p.count))
    assert seen == Counter({(n, r): 1 for n, c in histogram.items() for r in range(c)})
    plan = Plan(histogram, size)
    lengths = np.array([n for n, c in histogram.items() for _ in range(c)], dtype=np.int64)
    ranks = np.array([r for c in histogram.values() for r in range(c)], dtype=np.int64)
    held, parts = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in zip(*plan.find(lengths, ranks)):
        held[sequence].append((offset, n))
        parts[doc].append((start, n))
    gapless(held.values())
    gapless(parts.values())
    assert [sum(n for _, n in parts[d]) for d in range(len(lengths))] == lengths.tolist()
    assert sorted(held) == list(range(plan.sequences))
    fills = [sum(n for _, n in x) for x in held.values()]
    assert all(f <= size for f in fills) and sum(size - f for f in fills) < size
    kept, apart = taken_apart(patterns, size)
    assert sum(p.count for p in apart) * size <= sum(p.count * (size - p.filled) for p in patterns)
    cut = sum(p.count * len(p.slots) for p in apart)
    assert sum(len(x) > 1 for x in parts.values()) <= cut  # all others stay whole


def gapless(rows):
    for row in rows:
        at = 0
        for first, n in sorted(row):
            assert first == at and n > 0
            at += n


def test_a_plan_does_not_grow_with_the_number_of_documents():
    rng = random.Random(1)
    histogram = {n: rng.randrange(1, 60) for n in range(1, 1025)}
    few, many = (Plan({n: c * k for n, c in histogram.items()}, 1024) for k in (1, 10**9))
    assert len(many.rank) < 1.2 * len(few.rank) < 6000
    total = 10**9 * sum(n * c for n, c in histogram.items())
    assert many.sequences == -(-total // 1024)


def check(rows, docs, size=1024):
    """Every id in one piece, sequences without gaps, less than one sequence of padding."""
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(ids_of(text))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert at <= size
    assert sum(size - sum(n for _, n in x) for x in by_sequence.values()) < size
    for doc_id, found in by_doc.items():
        texts = [ids for d, ids in want.elements() if d == doc_id]
        if len(texts) > 1:
            continue  # copies share an id; counted below
        ids, at = texts[0], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want.elements())


def test_query_packs_every_document(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op13_shortest_pack(spark, sf_dir).collect(), docs)


def test_odd_documents_and_whole_sequences(spark, tmp_path):
    long = "a " * 40_000 + "end"
    docs = [(0, None), (1, ""), (2, " \n"), (3, long), (4, "x" * 9000), (5, "<|endoftext|> is text é　 z"), (6, "fit " * 1023), (None, "none")]
    docs += [(100 + i, "word " * (i % 37)) for i in range(300)]
    df = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, rank int, ids binary")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    check(op13_shortest_pack(spark, str(tmp_path)).collect(), docs)
    made = pack(spark.read.parquet(str(tmp_path / "documents.parquet"))).cache()
    total = Counter(i for _, t in docs for i in ids_of(t))
    found = Counter()
    for r in sequences(made).collect():
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert len(ids) == r.n_tokens <= 1024
        found.update(ids.tolist())
    assert found == total
    same = df.where("doc_id = 3").union(df.where("doc_id = 3"))
    assert pack(same).agg({"length": "sum"}).first()[0] == 2 * len(ids_of(long))
    assert pack(df.limit(0)).count() == 0


def test_pieces_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(encode, "MOST_KEPT_PIECES", 300)
    rng = random.Random(3)
    bits = ["a", "B", "é", "×", " ", "  ", "\t", "\r\n", "\xa0", "\x85", " ", "　", "'s", "'", "12", "<|endoftext|>", "<|", ">", "!", "...", "\x00", "\x1c", "東京", "😀", " the", "Ġ", "ª", "²"]
    for name in (encode.BYTE_BPE, encode.WORD_BPE):
        encoder = encode.Encoder(name)
        for _ in range(6):
            texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)] + [None]
            ids, n = encoder.encode(pa.array(texts))
            want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert n.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_the_windows_are_counted_within_their_part(spark):
    df = spark.createDataFrame([(i, "w " * (i % 5)) for i in range(200)], "doc_id long, text string").repartition(3)
    seen = defaultdict(list)
    for r in packing.windows(df).collect():
        seen[r.part, r.length].append(r.number)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and len({p for p, _ in seen}) == 3


def test_what_is_kept_of_pieces_has_a_fixed_size(monkeypatch):
    monkeypatch.setattr(encode, "MOST_KEPT_PIECES", 1 << 10)
    encoder = encode.Encoder(encode.BYTE_BPE)
    texts = [f" w{'abcdefghij'[k % 10] * (k % 17)}{chr(97 + k % 26)}" for k in range(400)] + ["a", "a\x00", "a\x00\x00", "b" * 15, "b" * 16]
    for k in range(40):
        more = texts + [f"{k} {chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + k % 26)}" for j in range(600)]
        ids, n = encoder.encode(pa.array(more))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in more]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(encoder.kept.low) == 1 << 10 and len(encoder.kept.flat) <= 1 << 16
