"""Byte-level BPE by backtracking over longest matches, the same ids as merging in order of rank, in linear time.

A token sequence is what BPE gives exactly when every two neighbouring tokens are compatible: merging the bytes of both,
BPE gives the two again. So a text is covered from the left with the longest token at each place; a token that doesn't fit
its predecessor gives way to its longest prefix that is a token, and a place from which nothing fits is marked dead and
left by backtracking. Each place is left once at most, which makes the work linear. The longest token at each place comes
from an Aho-Corasick automaton over the bytes as Latin-1 characters; compatibility is memoised for pairs of tokens, and
the ids of short pieces are memoised as a whole.

Texts are split by the vocabulary's pattern first, and each piece encoded on its own; a piece that is a token is that
token. Nulls: a null text counts as empty; a null doc_id keeps its row. Repeated rows get the same answer each. An empty
table gives no rows. Long texts are encoded piece by piece, so only their bytes are in memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from packgraph.llm.scratch import plain

PIECES = 1 << 16  # pieces of a text that are encoded at once
SHORT = 64  # characters of a piece that is memoised
MEMO = 200_000  # entries of each memo


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids, which must have no gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ids must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tables over the tokens. ``left`` and ``right`` hold the two tokens that a token is merged from, or itself twice."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.shorter = [next((j for n in range(len(t) - 1, 0, -1) if (j := self.ids.get(t[:n])) is not None), -1) for t in tokens]
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}
        for i, token in enumerate(tokens):  # a token's parts have smaller ids, so their own entries are there
            a = self.shorter[i]
            while a >= 0:
                b = self.ids.get(token[len(tokens[a]) :])
                if b is not None and a < i and b < i and self._compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break
                a = self.shorter[a]
        self._machine = None

    @property
    def tables(self) -> tuple:
        return self.tokens, self.ids, self.shorter, self.left, self.right, self.merged

    @classmethod
    def of(cls, tables: tuple) -> Vocabulary:
        made = cls.__new__(cls)
        made.tokens, made.ids, made.shorter, made.left, made.right, made.merged = tables
        made._fits, made._machine = {}, None
        return made

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE never merges across the border of a and b.

        Both are taken apart again, the later merge first. If the tokens that touch at the border make up a token whose
        merge comes before the one just undone, BPE would have taken that instead.
        """
        merged, left, right = self.merged, self.left, self.right
        bound = len(self.tokens)
        while True:
            both = merged.get((a, b))
            if both is not None and both < bound:
                return False
            undo_a, undo_b = right[a] != a, left[b] != b
            if undo_a and (a > b or not undo_b):
                bound, a = a, right[a]
            elif undo_b:
                bound, b = b + 1, left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a * len(self.tokens) + b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            known = self._fits[key] = self._compatible(a, b)
        return known

    def longest(self, data: bytes) -> list[int]:
        """The longest token that begins at each byte."""
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for i, token in enumerate(self.tokens):
                machine.add_word(token.decode("latin-1"), i)
            machine.make_automaton()
            self._machine = machine
        found, tokens = [-1] * len(data), self.tokens
        for end, i in self._machine.iter(data.decode("latin-1")):  # ends rise, so the longest of a start comes last
            found[end + 1 - len(tokens[i])] = i
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        first, dead = self.longest(data), bytearray(len(data) + 1)
        out: list[int] = []
        at, token = 0, first[0] if data else -1
        while at < len(data):
            if token >= 0 and not dead[at + len(self.tokens[token])] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at += len(self.tokens[token])
                token = first[at] if at < len(data) else -1
            elif token >= 0 and self.shorter[token] >= 0:
                token = self.shorter[token]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
            else:
                raise ValueError("the vocabulary lacks single bytes of this text")
        return out


class Encoder(dict):
    """From short pieces to the bytes of their ids, little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in parts."""
        if len(text) <= PIECES:
            yield b"".join(map(self.__getitem__, self.split.findall(text)))
            return
        matches = self.split.finditer(text)
        while part := [m.group() for m in islice(matches, PIECES)]:
            yield b"".join(map(self.__getitem__, part))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path``: a rank file, read on the driver; the tables over it, of fixed size, go to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)).tables)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.of(shared.value), pattern)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.encode(text or ""):
                    n += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(encoder.decode(ids))
                counts.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_text.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain(docs, doc_id="long", text="string").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
