"""Words of a text and 64-bit hashes of word windows, for Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _Codes(dict):
    """A 64-bit code for each word seen by this worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:         # some 40 MB
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than ``\\x20`` and ``\\x09``-``\\x0D``, as UTF-8;
    with ``lower`` A-Z in lower case."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """One hash for each ``width`` words in a row, in order."""
    if width < 1 or len(words) < width:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * np.uint64(_MIX[0]) + codes[j:n + j]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(31))
