"""Words of UTF-8 texts: runs of bytes other than ASCII white space."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import xxhash

#: ASCII white space: where bytes.split() cuts (fixed values).
SPACE = b" \t\n\x0b\f\r"
PIECE = 1 << 20  # bytes of a text that are split into words at once


def word_pieces(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists that come from about ``piece`` bytes each, so that long texts need no list of all."""
    at = 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and data[end] not in SPACE:
            step = min(len(data), end + 256)
            end = min((i for i in (data.find(SPACE[k : k + 1], end, step) for k in range(len(SPACE))) if i >= 0), default=step)
        yield data[at:end].split()
        at = end


class WordIds(dict):
    """Integers for words, exact as long as the object is not emptied, and a 64-bit hash of each that is the same everywhere."""

    def __init__(self, most: int = 1 << 15):
        super().__init__()
        self.most, self._hashes = most, array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self._hashes)
        self._hashes.append(xxhash.xxh64_intdigest(word))
        return at

    def of(self, text: bytes) -> np.ndarray:
        """The ids of a text's words; ids of different texts don't compare, since a full table is emptied between them."""
        if len(self) > self.most:
            self.clear()
            self._hashes = array("Q")
        parts = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in word_pieces(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return np.array(self._hashes, np.uint64)[ids] if len(ids) > len(self._hashes) else np.frombuffer(self._hashes, np.uint64)[ids]
