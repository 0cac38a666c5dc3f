"""Words of texts as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SEED = 42
#: Words whose hashes a Python worker remembers, and bytes of text that are split at once.
VOCABULARY = 1 << 15
PIECE = 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The SimHash: the bits that are set in over half of n hashes."""
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > n))


class Words(dict):
    """Word -> its 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found

    def hashes(self, text: bytes) -> np.ndarray:
        """The hashes of a text's words (runs of other than ASCII white space), in order. A very long text is split piece by piece."""
        parts, at = [], 0
        while at < len(text):
            cut = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = cut.end() if cut else len(text)
            if len(self) > VOCABULARY:
                self.clear()
            words = text[at:end].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
            at = end
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)
