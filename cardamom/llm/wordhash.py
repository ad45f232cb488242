"""Vectorised word hashing shared by the text operators of this subpackage.

A word's 64-bit hash depends on its bytes alone, whatever text, batch or machine
it stands in. Texts are hashed a bounded slice at a time, so memory follows the
number of words of one document and never the bytes of a whole partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED = 20240229
_RNG = np.random.default_rng(_SEED)
#: One random odd multiplier and one random value for each byte.
_BASE = int(_RNG.integers(1, 2**63)) * 2 + 1
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes hashed at once; a longer single word is hashed in one piece.
SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done, step = 1, base % 2**64
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(step)
        done += more
        step = pow(base, done, 2**64)
    return out


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


_CHARS, _WORDS = _Powers(_BASE), _Powers(int(_RNG.integers(1, 2**63)) * 2 + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def byte_class(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words between spaces, tabs and line ends; every byte over 0x7F is part of a word.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, lower-case ASCII letters and everything over 0x7F.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F)


def _slices(data: bytes, word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of data of SLICE bytes or so that no word crosses."""
    buf, at = np.frombuffer(data, np.uint8), 0
    while at < len(buf):
        end = min(len(buf), at + SLICE)
        if end < len(buf) and word[buf[end - 1]] and word[buf[end]]:
            gaps = np.flatnonzero(~word[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the slice: go on to its end
                while end < len(buf) and word[buf[end]]:
                    gaps = np.flatnonzero(~word[buf[end : end + SLICE]])
                    end = end + int(gaps[0]) if len(gaps) else min(len(buf), end + SLICE)
        yield at, buf[at:end]
        at = end


def words(data: bytes, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of UTF-8 bytes, positions in bytes."""
    hashes, starts, ends = [], [], []
    for at, buf in _slices(data, word):
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = word[buf]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _CHARS.get(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64)))
        starts.append(s + at)
        ends.append(e + at)
    if not hashes:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, in order."""
    if len(hashes) < n:
        return np.empty(0, U64)
    up, down = _WORDS.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def packs(texts: list[bytes | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with limit bytes together, or one longer text."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def many(texts: list[bytes | None], word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of several texts at once: hashes, starts, ends, first word of each text (and the end), joined bytes.

    Texts are joined by a space, so that no word crosses two of them.
    """
    joined = b" ".join(t or b"" for t in texts)
    h, s, e = words(joined, word)
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return h, s, e, np.searchsorted(s, offsets), joined


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
