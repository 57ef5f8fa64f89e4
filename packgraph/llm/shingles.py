"""Hashes of word shingles and what is made of them: SimHash fingerprints, MinHash keys and sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from packgraph.llm.words import PIECE, word_pieces

SEED = 42
BANDS, ROWS = 24, 5
SKETCH = 16  # longs
_COUNTED = 255  # bits are first counted in bytes
_DRAWS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingle_hashes(text: bytes, width: int, piece: int = PIECE) -> Iterator[bytes]:
    """The XXH64 digests of a UTF-8 text's lower-case word shingles, repeats included, 8 bytes each, in parts that come from
    about ``piece`` bytes of text. A text of fewer words than a shingle is one shingle; one without a word has none."""
    digest, carry, none = xxhash.xxh64_digest, [], True
    for words in word_pieces(text.lower(), piece):
        words = carry + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[: -width] + 1))
            yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())])
            none = False
        carry = words[-(width - 1) :] if width > 1 else []
    if none and carry:
        yield digest(b" ".join(carry), SEED)


def _set_bits(hashes: bytes) -> np.ndarray:
    """How many of the 8-byte hashes have each bit set, highest bit first."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    short = -len(rows) % _COUNTED
    if short:
        rows = np.concatenate((rows, np.zeros((short, 8), np.uint8)))
    bits = np.unpackbits(rows, axis=1).reshape(-1, _COUNTED, 64)
    return bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint_of(parts: Iterator[bytes]) -> int:
    """64 bits, unsigned; a bit is set if it is set in over half of the hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += _set_bits(hashes)
        total += len(hashes) // 8
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def fingerprint(text: bytes, width: int = 4, piece: int = PIECE) -> int:
    return fingerprint_of(shingle_hashes(text, width, piece))


def set_of(parts: Iterator[bytes]) -> np.ndarray:
    """The distinct hashes, in order."""
    found = [np.unique(np.frombuffer(x, np.uint64)) for x in parts]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def shingle_set(text: bytes, width: int = 5, piece: int = PIECE) -> np.ndarray:
    return set_of(shingle_hashes(text, width, piece))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed long for each band, from the least of the hashes under each of BANDS * ROWS random orders."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ _DRAWS[0]) * _DRAWS[1]).min(axis=0))
    data, size = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[i * size : (i + 1) * size]) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """Bits as signed longs; each hash flips one of them."""
    flips = np.bincount(((hashes >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).tolist()
