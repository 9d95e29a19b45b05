"""Words of whole texts as arrays of 64-bit hashes, straight from Arrow's buffers.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Its hash is a
polynomial over random values of its bytes, taken from running sums, so the
cost does not depend on how many words there are, and no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts, each of about ``size`` bytes, or one longer text."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


BYTE_VALUES = _byte_values()
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[*range(9, 14), 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n-1, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finisher whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


INVERSE = pow(BASE, -1, 1 << 64)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of the first word of each text."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    space = IS_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = ~space[at[:-1]]
    starts, ends = at[:-1][word], at[1:][word]
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes of each span, case of A-Z apart."""
    terms = BYTE_VALUES[data] * powers(BASE, len(data))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of the first word of each text and the last's end."""
    starts, ends, first = spans(data, offsets)
    return hashes(data, starts, ends), first
