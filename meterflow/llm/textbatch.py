"""Texts of an Arrow batch as one byte buffer, with words and their hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_rng = np.random.RandomState(20240611)
#: A random 64-bit value for each byte, and an odd base whose powers never vanish.
BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + _rng.randint(0, 2, 256).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i below n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes stirred, so that any of them can be used."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def pieces(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text (one row at least)."""
    ends = offsets(texts)[1:] - offsets(texts)[0]
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def large(texts) -> pa.Array:
    """One large_string array, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


class TextBatch:
    """``buf``: the texts' bytes, each text followed by a blank; text i is ``buf[start[i]:end[i]]``."""

    def __init__(self, texts: pa.Array):
        off = offsets(texts)
        n = len(texts)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        size = np.diff(off)
        self.n = n
        self.start = off[:-1] - off[0] + np.arange(n)
        self.end = self.start + size
        self.buf = np.insert(raw, np.cumsum(size), 0x20) if n else raw
        self.size = size

    def words(self, is_word: np.ndarray) -> None:
        """Find runs of bytes with ``is_word``; sets word starts, ends and the text of each word."""
        self._edges(is_word[self.buf])

    def _edges(self, inside: np.ndarray) -> None:
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(inside) else np.zeros(0, np.int64)
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.ws, self.we = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.ws, self.start)
        last = np.searchsorted(self.ws, self.end)
        self.n_words = last - self.first
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased if ``fold``."""
        up, down = powers(len(self.buf) + 1)
        value = BYTE[LOWER] if fold else BYTE
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(value[self.buf] * up[:-1], out=sums[1:])
        return mixed((sums[self.we] - sums[self.ws]) * down[self.ws])

    def bytes(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words (the result is k - 1 shorter)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += hashes[j : n + j]
    return mixed(out)
