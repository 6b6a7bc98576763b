"""Word shingles as 64-bit hashes, for Arrow batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """xxhash64 of a word, remembered for the words of this process up to a fixed number."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * P2
    h = (h ^ (h >> np.uint64(29))) * P1
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles.

    Words are runs of other bytes than space and 0x09-0x0D, with A-Z lower-cased (bytes.lower and bytes.split do
    exactly that). A text with fewer words is one shingle; one without words has none.
    """
    parts = text.lower().split() if text else ()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    if n < k:
        h = np.full(1, n, np.uint64)
        for x in w:
            h = mix(h * P1 + x)
        return h
    m = n - k + 1
    h = w[:m].copy()
    for i in range(1, k):
        h *= P1
        h ^= h >> np.uint64(33)
        h += w[i : i + m]
    return np.unique(mix(h))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def texts(batch, name: str) -> list[bytes | None]:
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
