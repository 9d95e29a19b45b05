"""Token ids of whole texts with the tokenizers library, in Arrow batches.

Where no token crosses certain places in a text, its ids are the ids of the
pieces between them in order, so each different piece is encoded once and the
rest is gathering. Two of the tokenizers are known that well:

- ``word_bpe_49k`` lower-cases, drops white space, and splits at it, at every
  ASCII digit and between ASCII letters, digits and punctuation.
- ``byte_bpe_50k`` keeps white space, which goes before the piece that follows
  it, and runs of digits. A piece ends before white space only after a printable
  ASCII byte or a letter from U+00C0 to U+00FF, which no white space ends in.

The apostrophe, ``<``, ``|``, ``>`` and other bytes beyond ASCII never end a
piece: contractions, special tokens, combining marks and symbols stay whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa

from claimhound.llm.words import utf8

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
BY_PIECE = frozenset({WORD_BPE, BYTE_BPE})
KEEP_SPACE = frozenset({BYTE_BPE})
TEXTS_A_CALL = 4096
#: Pieces that a worker remembers at most (32 bytes each, and 4 for each of as many ids four times).
MOST_KEPT_PIECES = 1 << 20
#: Longer pieces are not remembered.
KEY_BYTES = 15

SPACE, LETTER, DIGIT, MARK, WHOLE = range(5)


def _classes() -> np.ndarray:
    kind = np.full(256, WHOLE, dtype=np.uint8)
    kind[:128] = MARK
    kind[[ord(c) for c in "'<|>"]] = WHOLE
    kind[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[*range(9, 14), 32]] = SPACE
    return kind


CLASSES = _classes()
#: After these ASCII bytes a piece may end before white space.
PRINTABLE = np.zeros(256, dtype=bool)
PRINTABLE[0x21:0x7F] = True
#: Lead byte of U+00C0 to U+00FF, all letters or signs.
LATIN = 0xC3


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_NAMES = _byte_names()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: The bytes of a piece of each length among eight that are read from its first and from its ninth.
LOW_MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(KEY_BYTES + 1)], dtype=np.uint64)
HIGH_MASKS = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(KEY_BYTES + 1)], dtype=np.uint64)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Kept:
    """Ids of pieces seen before, in arrays of fixed size that are searched for many pieces at once.

    A piece of at most KEY_BYTES bytes is its own key: these bytes and its length. A
    key has one slot, which the last piece met for it takes. The ids of all are
    one after another in one array; all are forgotten when that is full.
    """

    def __init__(self, most: int) -> None:
        bits = max(1, (most - 1).bit_length())
        self.shift, self.most_ids = np.uint64(64 - bits), 4 * most
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.starts, self.counts = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def make_room(self) -> None:
        if self.used > self.most_ids:
            self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
            self.low[:] = self.high[:] = 0

    def find(self, keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of each key, where its ids start and how many they are; -1 if it is not known."""
        low, high = keys
        h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        slots = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)
        known = (self.high[slots] == high) & (self.low[slots] == low) & (high > 0)
        return slots, self.starts[slots], np.where(known, self.counts[slots], -1)

    def add(self, each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each new piece start and how many they are."""
        counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        ends = self.used + np.cumsum(counts)
        self.flat = _grown(self.flat, int(ends[-1]))
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(each), np.uint32, int(ends[-1]) - self.used)
        self.used = int(ends[-1])
        return ends - counts, counts

    def keep(self, slots: np.ndarray, keys: tuple[np.ndarray, np.ndarray], starts: np.ndarray, counts: np.ndarray) -> None:
        self.low[slots], self.high[slots] = keys
        self.starts[slots], self.counts[slots] = starts, counts


def _keys(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece: its bytes and, in the last one, its length; zeros if it is too long."""
    padded = np.concatenate((flat, np.zeros(16, dtype=np.uint8)))
    words = np.ndarray(len(flat) + 9, dtype="<u8", buffer=padded, strides=(1,))
    at, n = bounds[:-1], np.diff(bounds)
    n = np.where(n <= KEY_BYTES, n, 0)
    return words[at] & LOW_MASKS[n], words[at + 8] & HIGH_MASKS[n] | n.astype(np.uint64) << np.uint64(56)


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.resize(a, max(size, 2 * len(a)))


@lru_cache(maxsize=4)
def encoder(name: str = WORD_BPE) -> Encoder:
    """One for each worker, so that what it has learnt serves all its tasks."""
    return Encoder(name)


class Encoder:
    """``name``: a file of the public tokenizers, or a path that every executor has."""

    def __init__(self, name: str = WORD_BPE, by_piece: bool | None = None):
        path = name if os.path.sep in name else public_tokenizers.path(name)
        self.tokenizer = _tokenizer(path)
        self.by_piece = name in BY_PIECE if by_piece is None else by_piece
        self.keep_space = name in KEEP_SPACE
        self.kept = _Kept(MOST_KEPT_PIECES)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), TEXTS_A_CALL):
            part = texts[k : k + TEXTS_A_CALL]
            out += [
                e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            ]
        return out

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """A piece that is a single word needs no normalizer or splitting, only the model."""
        tokenize = self.tokenizer.model.tokenize
        words = [self._word(p) for p in pieces]
        rest = iter(self._whole([p for p, w in zip(pieces, words, strict=True) if w is None]))
        return [next(rest) if w is None else [t.id for t in tokenize(w)] for w in words]

    def _word(self, piece: str) -> str | None:
        """``piece`` as the model reads it, if it is plain letters (after one blank, where kept)."""
        if not self.keep_space:
            return piece if piece.isascii() and piece.isalpha() else None
        letters = piece[1:] if piece[0] == " " else piece
        if not letters.isalpha():
            return None
        if piece.isascii():
            return "\u0120" + letters if piece[0] == " " else piece
        return piece.encode().decode("latin-1").translate(BYTE_NAMES) if max(piece) <= "\xff" else None

    def _found(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece start in what is kept, and how many they are."""
        self.kept.make_room()
        keys = _keys(flat, bounds)
        slots, starts, counts = self.kept.find(keys)
        new = np.flatnonzero(counts < 0)
        if len(new):
            every = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(flat))
            coded = every.take(pa.array(new)).dictionary_encode()
            which = coded.indices.to_numpy()
            begins, n = self.kept.add(self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
            starts[new], counts[new] = begins[which], n[which]
            new = new[keys[1][new] > 0]
            self.kept.keep(slots[new], (keys[0][new], keys[1][new]), starts[new], counts[new])
        return starts, counts

    def _split(self, data: np.ndarray, kind: np.ndarray, solid: np.ndarray) -> np.ndarray:
        """Whether a piece may begin at each byte, whatever the texts' bounds."""
        split = np.ones(len(data), dtype=bool)
        a, b = kind[:-1], kind[1:]
        inner = (a != WHOLE) & (b != WHOLE)
        if not self.keep_space:
            split[1:] = (a == SPACE) | (((a != b) | (a == DIGIT)) & inner)
            return split & solid
        ended = PRINTABLE[data[:-1]]
        ended[1:] |= data[:-2] == LATIN
        split[1:] = np.where(b == SPACE, ended & (a != SPACE), (a != b) & inner & (a != SPACE))
        return split

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text. Null texts are empty."""
        if not self.by_piece:
            each = self._whole(texts.fill_null("").to_pylist())
            n = np.array([len(x) for x in each], dtype=np.int64)
            return np.array([i for x in each for i in x], dtype=np.uint32), n
        data, offsets = utf8(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        kind = CLASSES[data]
        solid = kind != SPACE
        split = self._split(data, kind, solid)
        begins = offsets[:-1][offsets[:-1] < len(data)]
        if self.keep_space:
            split[begins] = True
            at = np.flatnonzero(split)
            bounds, flat = np.append(at, len(data)).astype(np.int32), np.ascontiguousarray(data)
        else:
            split[begins] |= solid[begins]
            at = np.flatnonzero(split)
            inner = np.concatenate(([0], np.cumsum(solid, dtype=np.int32)))
            bounds, flat = np.append(inner[at], inner[-1]).astype(np.int32), LOWER[data[solid]]
        starts, n = self._found(flat, bounds)
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.kept.flat[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.searchsorted(at, offsets)])
