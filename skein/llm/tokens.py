"""Words of Arrow columns of texts, found and hashed without Python objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space parts words; A-Z count as a-z.
WORDS = np.array([32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Of ASCII, letters and digits alone make words; A-Z count as a-z.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


class Tokens:
    """All words of texts as places in their bytes, in order.

    table says what each byte counts as; a space parts words.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray = WORDS):
        texts = texts.fill_null("").cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        self.data = table[raw]
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = self.data != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = np.unique(edges[:-1])
        first[cut] = inside[cut]  # words end with their text
        last = inside[:-1] & ~(inside[1:] & ~first[1:])
        self.starts, self.ends = np.flatnonzero(first[:-1]), np.flatnonzero(last) + 1
        #: Words of each text.
        self.n = np.diff(np.searchsorted(self.starts, edges))

    def hashes(self) -> np.ndarray:
        return hash_words(self.data, self.starts, self.ends)


#: Words are hashed as polynomials in an odd number, whose inverse moves them to their own start.
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_SEGMENT = 1 << 17
_powers = np.ones((2, 0), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        base = np.array([[_ODD], [pow(_ODD, -1, 1 << 64)]], np.uint64)
        _powers = np.cumprod(np.c_[np.ones((2, 1), np.uint64), np.repeat(base, n - 1, axis=1)], axis=1, dtype=np.uint64)
    return _powers


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes (signed) of data[start:end] each; words follow one another."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _SEGMENT, side="right")))
        size = int(ends[j - 1] - low)
        up, down = _powers_to(max(size, _SEGMENT))
        run = np.zeros(size + 1, np.uint64)
        np.cumsum((data[low : low + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=run[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    for turn in (32, 29):
        out ^= out >> np.uint64(turn)
        out *= _MIX
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def word_hash(word: bytes) -> int:
    return int(hash_words(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def types_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's type number, the types' hashes, and where each type is first."""
    coded = pa.array(hashes).dictionary_encode()
    local, types = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.empty(len(types), np.int64)
    first[local[::-1]] = np.arange(len(local) - 1, -1, -1)
    return local, types, first
