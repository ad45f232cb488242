"""BPE encoding by backtracking over longest matches, decoding by a table of offsets.

Of every position of a pre-token the longest token that begins there is known: an Aho-Corasick
automaton of all tokens, reversed, reads the reversed pre-token once. The encoder takes longest
tokens from left to right. A token stands if it is compatible with the one before it, that is, if
BPE on both their bytes gives just these two; else the next shorter token that begins it is tried,
and if none is left, the position is given up for good and the token before it is shortened.
Neighbours that are pairwise compatible are what BPE's merges make of the whole, and every position is
given up once at most, so time is linear in the bytes.

Whether two tokens are compatible follows from the table of merges alone: the tokens at their border are
split again, latest first, and no pair that ever stood at the border may have been due before one
of its own sides was merged.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .bpe import SAFE_CUT
from .common import map_text

#: Characters that are split into pre-tokens at once, where a safe cut allows it.
CHUNK = 1 << 16
#: Pre-tokens whose ids are remembered, the characters of a remembered one, and pairs of tokens whose compatibility is.
REMEMBERED, REMEMBERED_CHARS, PAIRS = 1 << 17, 32, 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that vocabulary files write it as: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary in which every token is one byte or made by one merge of two tokens that came before it."""

    def __init__(self, tokens: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]]) -> None:
        size = max(tokens.values(), default=-1) + 1
        self.rank = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, made = tokens[a], tokens[b], tokens[a + b]
            if self.left[made] >= 0 or any(len(t) > 1 and self.left[i] < 0 for t, i in ((a, x), (b, y))):
                raise ValueError(f"merge {rank} doesn't make a new token of earlier ones")
            self.rank[made], self.left[made], self.right[made] = rank, x, y
            self.merge[x, y] = rank
        #: The pair-compatibility table, filled as pairs occur.
        self.fits = _Kept(lambda pair: self.compatible(*pair), PAIRS)
        # a token that BPE itself wouldn't make of its bytes never occurs
        self.tokens = {t: i for t, i in tokens.items() if (len(t) == 1 if self.left[i] < 0 else self.compatible(self.left[i], self.right[i], self.rank[i]))}
        self.size = [0] * size
        for t, i in self.tokens.items():
            self.size[i] = len(t)
        # the next shorter token that begins each token
        self.shorter = [-1] * size
        for t, i in self.tokens.items():
            self.shorter[i] = next((self.tokens[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.tokens), -1)
        self.ends = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.ends.add_word(t[::-1].decode("latin-1"), i)
        if self.tokens:
            self.ends.make_automaton()

    def compatible(self, a: int, b: int, before: float = inf) -> bool:
        """Whether BPE leaves a and b apart (until a merge of rank `before`) if they stand side by side.

        Of equal merges the one further left is made first, so a merge across the border must be due
        before the left side's own, but not after the right side's.
        """
        rank, merge = self.rank, self.merge
        a_due = b_due = before
        while True:
            r = merge.get((a, b))
            if r is not None and r < a_due and (r <= b_due if b_due is not before else r < before):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                a_due, a = rank[a], self.right[a]
            else:
                b_due, b = rank[b], self.left[b]

    def longest(self, data: bytes) -> dict[int, int]:
        """The longest token that begins at each position, by the number of bytes from there to the end."""
        if not self.tokens:
            return {}
        # of the matches that end at one place the longest comes first
        return dict([(end + 1, token) for end, token in self.ends.iter(data[::-1].decode("latin-1"))][::-1])

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Ids of a pre-token's bytes; ValueError if the vocabulary lacks one of them."""
        if (whole := self.tokens.get(data)) is not None:
            return (whole,)
        longest, size, shorter, fits, n = self.longest(data), self.size, self.shorter, self.fits, len(data)
        if len(longest) < n:
            raise ValueError("the vocabulary lacks a byte")
        given_up: set[int] = set()
        ids: list[int] = []
        at, before, token = 0, -1, longest.get(n, -1)
        while at < n:
            while token >= 0 and (at + size[token] in given_up or before >= 0 and not fits[before, token]):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += size[token]
                before, token = token, longest.get(n - at, -1)
            else:
                given_up.add(at)
                token = ids.pop()
                before = ids[-1] if ids else -1
                at -= size[token]
        return tuple(ids)


class _Kept(dict):
    """What a function gives, of which two generations of a bounded number are kept."""

    def __init__(self, f, most: int, widest: int | None = None) -> None:
        self._f, self._most, self._widest, self._older = f, most, widest, {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._f(key)
        if self._widest is None or len(key) <= self._widest:
            if len(self) >= self._most:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


class Coder:
    """Encoder and decoder of a vocabulary file of byte-level BPE, as the tokenizers library reads it.

    The file's truncation and padding are unused. Its added tokens are found in texts, and a decoded text has them.
    """

    def __init__(self, content: bytes, pattern: str) -> None:
        file = json.loads(content)
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or file["normalizer"] or file["post_processor"] or model.get("dropout") or any(model.get(k) for k in ("byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = {a["content"]: a["id"] for a in file["added_tokens"]}
        if any(a[k] for a in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on what is beside them aren't supported")
        alphabet = byte_alphabet()

        def as_bytes(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        tokens = {as_bytes(t): i for t, i in model["vocab"].items() if t not in added}
        self._merges = Merges(tokens, [(as_bytes(a), as_bytes(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])])
        self._as_bytes = as_bytes
        self._added = added
        self._cut_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self._pieces = regex.compile(pattern).findall
        self._settled: set[str] = set()
        self._odd: set[str] = set()
        self._ids = _Kept(lambda piece: self._merges.encode(piece.encode("utf-8")), REMEMBERED, REMEMBERED_CHARS)
        by_id = {i: t for t, i in tokens.items()} | {i: t.encode("utf-8") for t, i in added.items()}
        spelled = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self._blob = np.frombuffer(b"".join(spelled), np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in spelled], dtype=np.int64)]).astype(np.int64)

    def _alike(self, c: str) -> bool:
        """Whether the pattern's engine and the library take a character for the same kind (letter, number, white space or other): their Unicode tables may differ."""
        return all([len(p.encode("utf-8")) for p in self._pieces(s)] == [len(p) for p, _ in self._library.pre_tokenize_str(s)] for s in (f"a{c}", f"1{c}", f"!{c}", f"{c}a", f" {c}"))

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text as the library splits it, which does so itself where it knows a character differently."""
        chars = set(text)
        for c in chars - self._settled - self._odd:
            (self._settled if self._alike(c) else self._odd).add(c)
        if chars.isdisjoint(self._odd):
            return self._pieces(text)
        return [self._as_bytes(p).decode("utf-8") for p, _ in self._library.pre_tokenize_str(text)]

    @staticmethod
    def _chunks(text: str) -> Iterator[str]:
        """A text in parts of CHUNK characters or more, cut where white space follows another character: no pre-token stands across that."""
        at = 0
        while len(text) - at > CHUNK:
            cut = SAFE_CUT.search(text, at + CHUNK - 1)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def _ordinary(self, text: str, ids: array) -> None:
        for chunk in self._chunks(text):
            ids.extend(chain.from_iterable(map(self._ids.__getitem__, self.pre_tokens(chunk))))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, unsigned 32-bit."""
        ids, at = array("I"), 0
        for m in self._cut_added.finditer(text) if self._cut_added else ():
            self._ordinary(text[at : m.start()], ids)
            ids.append(self._added[m[0]])
            at = m.end()
        self._ordinary(text[at:] if at else text, ids)
        return np.frombuffer(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are no UTF-8 give way to U+FFFD."""
        ids = np.asarray(ids, np.int64)
        begins = self._offsets[ids]
        sizes = self._offsets[ids + 1] - begins
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)
        data = self._blob[at].tobytes()
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode("utf-8")
        return data


@lru_cache(2)
def _coder(content: bytes, pattern: str) -> Coder:
    """A vocabulary's coder, made once in each Python worker."""
    return Coder(content, pattern)


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded binary (UTF-8).

    `vocabulary` is the content of a JSON file (1.5 MB, whatever the data), sent with the task's code. A
    null text is taken as empty: no tokens, empty ids and bytes; so is an empty one. A text of any length is
    encoded whole, in time linear in it, a chunk of pre-tokens at a time. Equal rows give equal
    rows, an empty table an empty one. Other columns take no part; a kept one that has an output's name gives way to it.
    """

    def factory():
        coder = _coder(vocabulary, pattern)

        def kernel(texts):
            counts, ids, back = [], [], []
            for t in texts:
                found = coder.encode((t or b"").decode("utf-8", "replace"))
                counts.append(len(found))
                ids.append(found.astype("<u4").tobytes())
                back.append(coder.decode(found))
            return pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())

        return kernel

    return map_text(docs, "n_tokens long, ids binary, decoded binary", factory, text, keep)
