"""Edit-aware token counts: a tree of pre-token segments for each text.

A text is cut at safe cuts (see bpe), which are borders of pre-tokens whatever stands on
either side, so that its count is the sum of its segments' counts. The segments are the
leaves of a binary tree whose nodes hold the characters and tokens below them. An edit
finds the segments it touches by those sums, encodes them anew together with as much of
their neighbours as it takes for both borders to be safe cuts again, and corrects the sums
on the way to the root; all other segments keep their counts. Trees are kept as a table of
their leaves' sums beside the texts, from which they are made again without encoding.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import SAFE_CUT, ByteBPE, read_ranks
from .common import map_text

#: Characters of a segment, about; a longer stretch without a safe cut is one segment.
SEGMENT = 256
#: Depth at which a tree is built anew from its leaves.
_DEEP = 200


class Node:
    __slots__ = ("chars", "tokens", "left", "right", "text", "depth")

    def __init__(self, left: Node | None, right: Node | None, text: str | None = None, tokens: int = 0) -> None:
        self.left, self.right, self.text = left, right, text
        if text is not None:
            self.chars, self.tokens, self.depth = len(text), tokens, 0
        else:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.depth = 1 + max(left.depth, right.depth)


def _join(a: Node | None, b: Node | None) -> Node | None:
    return Node(a, b) if a and b else a or b


def _build(leaves: Sequence[Node]) -> Node | None:
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return Node(_build(leaves[:half]), _build(leaves[half:]))


def _leaves(node: Node | None) -> list[Node]:
    out, todo = [], [node] if node else []
    while todo:
        x = todo.pop()
        if x.text is not None:
            out.append(x)
        else:
            todo += [x.right, x.left]
    return out


def _split(node: Node | None, at: int, after: bool) -> tuple[Node | None, Node | None]:
    """Cuts a tree at a border of segments: the last one at or before `at`, or with `after` the first at or after it."""
    if node is None:
        return None, None
    if node.text is not None:
        if at <= 0 or (at < node.chars and not after):
            return None, node
        return node, None
    if at < node.left.chars or (at == node.left.chars and after):
        a, b = _split(node.left, at, after)
        return a, _join(b, node.right)
    a, b = _split(node.right, at - node.left.chars, after)
    return _join(node.left, a), b


def _end(node: Node, last: bool) -> Node:
    while node.text is None:
        node = node.right if last else node.left
    return node


class TokenTree:
    """The token count of a text under edits. `encoded` adds up the characters that were encoded."""

    def __init__(self, bpe: ByteBPE, text: str, leaves: Sequence[tuple[int, int]] | None = None) -> None:
        """`leaves`, if known, has the characters and tokens of each segment; leaves that don't add up to the text are made anew."""
        self.bpe, self.encoded = bpe, 0
        if leaves is None or any((c or 0) <= 0 or t is None for c, t in leaves) or sum(c for c, _ in leaves) != len(text):
            self.root = _build(self._segments(text))
            return
        kept, at = [], 0
        for chars, tokens in leaves:
            kept.append(Node(None, None, text[at : at + chars], tokens))
            at += chars
        self.root = _build(kept)

    def _segments(self, text: str) -> list[Node]:
        out, at = [], 0
        while at < len(text):
            cut = SAFE_CUT.search(text, at + SEGMENT)
            end = cut.end() if cut else len(text)
            out.append(Node(None, None, text[at:end], len(self.bpe.encode(text[at:end]))))
            at = end
        self.encoded += len(text)
        return out

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def leaves(self) -> list[tuple[int, int]]:
        return [(x.chars, x.tokens) for x in _leaves(self.root)]

    def edit_all(self, edits: Sequence[dict | None] | None) -> None:
        for e in edits or ():
            if e is not None:
                self.edit(e["start"] or 0, self.chars if e["end"] is None else e["end"], e["text"] or "")

    def text(self) -> str:
        return "".join(x.text for x in _leaves(self.root))

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in the place of characters start to end; positions beyond the text mean its end."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        left, rest = _split(self.root, start, False)
        before = left.chars if left else 0
        middle, right = _split(rest, end - before, True)
        old = "".join(x.text for x in _leaves(middle))
        region = old[: start - before] + new + old[end - before :]
        while left and not (region and SAFE_CUT.match(_end(left, True).text[-1] + region[0])):
            left, last = _split(left, left.chars - 1, False)
            region = "".join(x.text for x in _leaves(last)) + region
        while right and not (region and SAFE_CUT.match(region[-1] + _end(right, False).text[0])):
            first, right = _split(right, 1, True)
            region += "".join(x.text for x in _leaves(first))
        self.root = _join(_join(left, _build(self._segments(region))), right)
        if self.root and self.root.depth > _DEEP:
            self.root = _build(_leaves(self.root))


_TREE = "text string, leaves array<struct<chars: int, tokens: int>>, n_tokens long"


def _rows(trees: Sequence[TokenTree]) -> list:
    return [[t.text() for t in trees], [[{"chars": a, "tokens": b} for a, b in t.leaves()] for t in trees], [t.tokens for t in trees]]


def count(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, text, leaves array<struct<chars, tokens>>, n_tokens long: a table that keeps each text's tree.

    A null text is taken as empty, which has no leaves.
    """

    def factory():
        bpe = ByteBPE(read_ranks(vocabulary), pattern)
        return lambda texts: _rows([TokenTree(bpe, (t or b"").decode("utf-8", "replace")) for t in texts])

    return map_text(docs, _TREE, factory, text, keep)


def edited(trees: DataFrame, vocabulary: bytes, pattern: str, edits: str = "edits", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A table of count(), or of this function, after the edits of each text: its columns, and n_reencoded long.

    `edits` is as in count_edited(). Only segments that the edits touch are encoded; null leaves, and those that
    don't add up to their text, are made anew.
    """

    def factory():
        bpe = ByteBPE(read_ranks(vocabulary), pattern)

        def kernel(texts, leaves, todo):
            made, had = [], []
            for t, known, es in zip(texts, leaves.to_pylist(), todo.to_pylist(), strict=True):
                tree = TokenTree(bpe, (t or b"").decode("utf-8", "replace"), None if known is None else [(x["chars"], x["tokens"]) for x in known])
                had.append(tree.encoded)
                tree.edit_all(es)
                made.append(tree)
            return [*_rows(made), [t.encoded - h for t, h in zip(made, had, strict=True)]]

        return kernel

    return map_text(trees, f"{_TREE}, n_reencoded long", factory, "text", keep, ["leaves", edits])


def count_edited(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", edits: str = "edits", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_tokens, n_chars_edited, n_tokens_edited, n_reencoded: all long.

    `edits` holds an array of struct<start, end, text> for each text, done in its order; positions
    are code points of the text as it is by then. A null text is taken as empty, a null array as
    none, a null edit as none, a null new text as empty, a null start as the text's beginning and a
    null end as its end. `n_reencoded` counts the characters that the edits had encoded.
    """

    def factory():
        bpe = ByteBPE(read_ranks(vocabulary), pattern)

        def kernel(texts, edits):
            out: list[list[int]] = [[], [], [], []]
            for t, todo in zip(texts, edits.to_pylist(), strict=True):
                tree = TokenTree(bpe, (t or b"").decode("utf-8", "replace"))
                first, had = tree.tokens, tree.encoded
                tree.edit_all(todo)
                for column, x in zip(out, (first, tree.chars, tree.tokens, tree.encoded - had), strict=True):
                    column.append(x)
            return [pa.array(c, pa.int64()) for c in out]

        return kernel

    return map_text(docs, "n_tokens long, n_chars_edited long, n_tokens_edited long, n_reencoded long", factory, text, keep, [edits])
