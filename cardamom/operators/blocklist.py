"""Long blocklists: an automaton of the texts that patterns require picks the patterns worth running.

Most patterns of a blocklist can only match where some fixed text stands. One pass of an
Aho-Corasick automaton over a leaf finds which of these texts it has; only patterns whose text is there, and those that
require none, are run on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship, spread

#: Letters that a pattern which ignores case takes for i, and that case folding doesn't.
_DOTS = str.maketrans({"İ": "i", "ı": "i"})


def folded(text: str) -> str:
    """A text such that texts which match when case is ignored are equal."""
    return text.translate(_DOTS).casefold()


def required(pattern: str) -> str:
    """The longest text, folded, that every match of a pattern holds; '' if none is found.

    Only plain characters and escaped signs outside of groups and classes count, and none of a pattern with alternatives.
    """
    if "|" in pattern or "(?" in pattern:
        return ""
    runs, run, at, depth = [], "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        size, plain = 1, ""
        if c == "\\":
            size = 2
            escaped = pattern[at + 1 : at + 2]
            plain = escaped if escaped and not escaped.isalnum() else ""
            if not plain and escaped not in "bBAZdDsSwW":
                return ""  # an escape of more than one letter
        elif c == "[":
            end = pattern.find("]", at + (3 if pattern[at + 1 : at + 2] == "^" else 2))
            # an escaped bracket inside: too much for this look
            if end < 0 or "\\]" in pattern[at:end + 1]:
                return ""
            size = end - at + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in ".^$*+?{}":
            plain = c
        follows = pattern[at + size : at + size + 1]
        if c == "{":
            size = max(pattern.find("}", at) - at + 1, 1)
        if depth or not plain or follows in ("*", "?", "{"):
            runs.append(run)
            run = ""
        else:
            run += plain
            if follows == "+":
                runs.append(run)
                run = ""
        at += size
    return max((folded(r) for r in [*runs, run]), key=len)


class Blocklist:
    """Patterns by name, in order. They are Python's, ignore case and know Unicode."""

    def __init__(self, patterns: Sequence[tuple[str, str]]) -> None:
        import ahocorasick

        self._patterns = list(patterns)
        self._compiled: dict[int, re.Pattern] = {}
        self._always: list[int] = []
        by_text: dict[str, list[int]] = {}
        for i, (_, p) in enumerate(self._patterns):
            text = required(p)
            (by_text.setdefault(text, []) if text else self._always).append(i)
        self._texts = ahocorasick.Automaton()
        for text, which in by_text.items():
            self._texts.add_word(text, which)
        if by_text:
            self._texts.make_automaton()
        self.ran = 0

    def candidates(self, text: str) -> list[int]:
        """Places of the patterns that may match."""
        found = set(self._always)
        if len(self._texts):
            for _, which in self._texts.iter(folded(text)):
                found.update(which)
        return sorted(found)

    def hits(self, text: str) -> list[tuple[str, str]]:
        """(name, leftmost match) of the patterns that match, in their order; an empty match is none."""
        out = []
        for i in self.candidates(text):
            name, pattern = self._patterns[i]
            compiled = self._compiled.get(i) or self._compiled.setdefault(i, re.compile(pattern, re.I))
            self.ran += 1
            m = compiled.search(text)
            if m and m[0]:
                out.append((name, m[0]))
        return out


def blocked(leaves: DataFrame, text: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """leaves, without their text, x (pattern, match) of each pattern that matches, with its leftmost match.

    Null and empty texts have no hits. A list of patterns is a setting, some thousands at most; it goes with the task's code.
    """
    for _, p in patterns:
        re.compile(p, re.I)  # a broken pattern is an error here
    ship(leaves.sparkSession)
    keep = [c for c in leaves.columns if c != text]
    source = spread(leaves.select(*keep, leaves[text].cast("string").alias("__text")))
    schema = StructType([*[source.schema[c] for c in keep], StructField("pattern", StringType()), StructField("match", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocklist = Blocklist(patterns)
        for b in batches:
            at, names, matches = [], [], []
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                for name, match in blocklist.hits(t or ""):
                    at.append(i)
                    names.append(name)
                    matches.append(match)
            kept = b.select(keep).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(matches, pa.string())], names=[*keep, "pattern", "match"])

    return source.mapInArrow(run, schema)
