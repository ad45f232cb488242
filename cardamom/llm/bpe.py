"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into halves down to short leaves, which are encoded on their own. Two
neighbours join by encoding a window around their border again. The window grows to
either side until the tokens outside it are proven to stay, which holds at a *safe cut*,
a character that is not white space followed by one that is: no alternative of the
pre-token pattern matches across it (white space only ever begins a match or fills it),
and neither side's matches depend on what lies beyond it. Where a half has no safe cut
the window takes all of it, however long it is: one engine splits windows of all sizes,
since the Unicode tables of another one differ.

Decoding concatenates the bytes of the halves. Joining is associative, with the
empty text as unit, so any tree over the same text gives the same ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import map_text

#: Characters of a leaf, ids that are decoded at once.
LEAF = 8192
#: Characters to either side of a border in the first window; each further one has four times as many.
WINDOW = 32
#: A safe cut: one that holds under any definition of white space.
SAFE_CUT = re.compile(r"\S(?=[ \t\n\r])")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines `base64 rank` of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class ByteBPE:
    """Encoder and decoder of one vocabulary, as tiktoken's encode_ordinary gives it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self._core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._cut = SAFE_CUT.finditer

    def _last_cut(self, text: str, lo: int, hi: int) -> int:
        """The last safe cut of text[lo:hi], or lo."""
        n = WINDOW
        while True:
            at = max(lo, hi - n)
            found = [m.end() for m in self._cut(text, at, hi)]
            if found or at == lo:
                return found[-1] if found else lo
            n *= 4

    def _first_cut(self, text: str, lo: int, hi: int) -> int:
        """The first safe cut of text[lo:hi], or hi."""
        n = WINDOW
        while True:
            end = min(hi, lo + n)
            if (found := next(self._cut(text, lo, end), None)) is not None:
                return found.end()
            if end == hi:
                return hi
            n *= 4

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        if not left or not right:
            return left or right
        p, q = self._last_cut(text, lo, mid), self._first_cut(text, mid, hi)
        direct = self._core.encode_ordinary
        keep = len(left) - len(direct(text[p:mid])) if p > lo else 0
        skip = len(direct(text[mid:q])) if q < hi else len(right)
        return left[:keep] + direct(text[p:q]) + right[skip:]

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self._core.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return self._tree(text, 0, len(text))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids; a window of ids need not be whole characters."""
        if len(ids) <= LEAF:
            return b"".join(map(self._bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded binary.

    `vocabulary` is the content of a rank file (about a megabyte, whatever the data), sent with
    the task's code. A null text is taken as empty: no tokens, empty ids and bytes. Equal texts
    give equal rows, an empty table an empty one; other columns take no part.
    """

    def factory():
        bpe = ByteBPE(read_ranks(vocabulary), pattern)

        def kernel(texts):
            counts, ids, back = [], [], []
            for t in texts:
                found = bpe.encode((t or b"").decode("utf-8", "replace"))
                counts.append(len(found))
                ids.append(np.array(found, "<u4").tobytes())
                back.append(bpe.decode(found))
            return pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())

        return kernel

    return map_text(docs, "n_tokens long, ids binary, decoded binary", factory, text, keep)
