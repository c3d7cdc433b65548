"""Words of texts as 64-bit hashes, and n-word windows of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ONE = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers that spread bits
TWO = np.uint64(0xC2B2AE3D27D4EB4F)
KEPT = 200_000


class WordHashes(dict):
    """Hash of each word seen; forgets all when it holds KEPT words, as hashes don't depend on what came before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """Hashes of the words (runs of anything but the six ASCII spaces), with A-Z lower-cased if asked."""
    raw = text.encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * ONE
    x = x ^ (x >> np.uint64(29))
    return x * TWO


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; none if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = h[:m].copy()
    for k in range(1, n):
        acc = acc * ONE + h[k : k + m]
    return mix(acc)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of a shorter text, of its whole sequence; none without words."""
    h = word_hashes(text or "")
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(windows(h, min(n, len(h))))


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``limit`` bytes of text, or of one longer text: what a task holds at once."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to
