"""Word shingles as 64-bit hashes, for whole batches of texts, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to 64-bit hash, computed on first sight; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() cuts at exactly space and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` word hashes, in order."""
    n = max(len(hashes) - width + 1, 0)
    out = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        out = mixed(out + hashes[i : i + n])
    return out


def shingle_set(text: str | None, known: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a shorter text is one shingle, one without words is empty."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    return np.unique(window_hashes(hashes, min(width, len(found))))
