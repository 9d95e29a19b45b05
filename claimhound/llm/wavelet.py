"""Wavelet matrix: a sequence of token ids as bit-planes with rank and select.

Plane k holds bit k (highest first) of every id, in the order that the planes
before it leave: zeros first, then ones, each in their old order. Token access,
counting and occurrence lookup follow one path of one bit per plane.

Bytes of one shard: magic, the header's length (uint32), a JSON header with
the counts and the sizes of the parts, then the parts, each compressed on its
own: document ids (int64), tokens per document (uint32), and per plane its
packed bits and the ones before every block of 512 bits (uint32).
"""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512


def _places(ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the zeros and of the ones; far cheaper than masks for bits without a pattern."""
    return np.flatnonzero(~ones), np.flatnonzero(ones)


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard. ``doc_ids`` must hold no null; ``lengths`` sum to ``len(ids)``."""
    press = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    parts = [press(doc_ids.astype("<i8").tobytes()), press(lengths.astype("<u4").tobytes())]
    zeros = []
    for level in range(levels):
        ones = (seq & (1 << (levels - 1 - level))) != 0
        packed = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
        padded[: len(packed)] = packed
        in_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
        ranks = np.concatenate(([0], np.cumsum(in_block)))
        parts += [press(padded.tobytes()), press(ranks.astype("<u4").tobytes())]
        zeros.append(len(seq) - int(ranks[-1]))
        seq = np.concatenate([seq[at] for at in _places(ones)])
    head = {"tokens": len(ids), "docs": len(doc_ids), "levels": levels, "zeros": zeros}
    header = json.dumps(head | {"parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, np.uint32(len(header)).tobytes(), header, *parts])


class Shard:
    """Reads one shard; a plane is decompressed when it is first needed."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a shard of token ids")
        size = int(np.frombuffer(data[4:8], dtype="<u4")[0])
        head = json.loads(bytes(data[8 : 8 + size]))
        self.tokens, self.levels, self.zeros = head["tokens"], head["levels"], head["zeros"]
        at = 8 + size + np.concatenate(([0], np.cumsum(head["parts"])))
        self._parts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.doc_ids = self._read(0, "<i8")
        self.lengths = self._read(1, "<u4").astype(np.int64)

    def _read(self, k: int, kind: str) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(self._parts[k]), dtype=kind)

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            k = 2 + 2 * level
            self._planes[level] = self._read(k, "u1"), self._read(k + 1, "<u4")
        return self._planes[level]

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[0][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        bits, ranks = self._plane(level)
        block = i // BLOCK
        rest = np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(rest[: i - block * BLOCK].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit that equals ``bit``."""
        bits, ranks = self._plane(level)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        inside = np.unpackbits(
            bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little"
        )
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` at places from ``start`` up to ``end``."""
        a, b = self._range(token, start, self.tokens if end is None else end)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """The whole sequence, rebuilt from the last plane to the first."""
        seq = np.zeros(self.tokens, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            packed = self._plane(level)[0]
            ones = np.unpackbits(packed, bitorder="little", count=self.tokens).view(bool)
            zeros, before = self.zeros[level], np.empty_like(seq)
            seq[zeros:] |= seq.dtype.type(1 << (self.levels - 1 - level))
            at_zeros, at_ones = _places(ones)
            before[at_zeros], before[at_ones] = seq[:zeros], seq[zeros:]
            seq = before
        return seq.astype(np.uint32)
