"""Benchmark decontamination: a suffix automaton of test items, past which training texts stream."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import map_text, stored
from .wordhash import ALNUM, SLICE, many, packs, words

#: Consecutive words of a window.
WINDOW = 13
#: Characters of benchmark text in one automaton: some 100 MB in a worker. More items make more automata, in turn.
ITEM_CHARS = 1_500_000
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def item_words(text: bytes) -> list[bytes]:
    text = text.lower()
    _, s, e = words(text, ALNUM)
    return [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class Items:
    """The automaton of some items, and what ends at its states."""

    def __init__(self, items: Sequence[tuple[str | None, bytes]], window: int) -> None:
        known: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            if found := tuple(item_words(text)):
                known.setdefault(found, set()).update([item] if item is not None else [])
        self.window, self.automaton = window, SuffixAutomaton()
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for found in known for w in found))}
        coded = [([self.vocabulary[w] for w in found], ids) for found, ids in known.items()]
        for code, _ in coded:
            self.automaton.add(code)
        self.shortest = min((min(window, len(code)) for code, _ in coded), default=window)
        # (state, length of a window) -> the items that have it
        self.ends: dict[int, dict[int, set[str]]] = {}
        for code, ids in coded:
            n = min(window, len(code))
            for v, m in self.automaton.match(code, n):
                if m == n:
                    self.ends.setdefault(v, {}).setdefault(n, set()).update(ids)
        self.hashes = np.unique(words(b" ".join(self.vocabulary), ALNUM)[0])

    def hits(self, code: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered intervals of a run of vocabulary words, and the items met."""
        link, ends, spans, met = self.automaton.link, self.ends, [], set()
        for i, (v, n) in enumerate(self.automaton.match(code, self.window), 1):
            if n < self.shortest:
                continue
            longest = 0
            while v > 0:
                for m, ids in ends.get(v, {}).items():
                    if m <= n:
                        longest = max(longest, m)
                        met |= ids
                v = link[v]
            if longest:
                lo = i - longest
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i))
        return spans, met


@functools.lru_cache(maxsize=1)
def _built(items: tuple, window: int) -> Items:
    return Items(items, window)


def _scan(texts: list[bytes | None], items: Items) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    counts, hits, met = [], [], []
    for lo, hi in packs(texts, SLICE):
        h, s, e, first, joined = many([(t or b"").lower() for t in texts[lo:hi]], ALNUM)
        known = items.hashes[np.minimum(np.searchsorted(items.hashes, h), max(0, len(items.hashes) - 1))] == h if len(items.hashes) else np.zeros(len(h), bool)
        # runs of words of the vocabulary in one text, long enough for a window
        edge = np.zeros(len(h) + 1, bool)
        edge[first] = True
        start = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = end - start >= items.shortest
        start, end = start[long], end[long]
        own = np.searchsorted(first, start, "right") - 1
        spans: dict[int, tuple[list[dict], set[str]]] = {}
        for d, a, b in zip(own.tolist(), start.tolist(), end.tolist(), strict=True):
            code = [items.vocabulary.get(joined[x:y], -1) for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)]
            found, ids = items.hits(code)
            if found:
                flat, all_ids = spans.setdefault(d, ([], set()))
                flat += [{"start": int(x + a - first[d]), "end": int(y + a - first[d])} for x, y in found]
                all_ids |= ids
        counts += np.diff(first).tolist()
        for d in range(hi - lo):
            flat, ids = spans.get(d, ([], ()))
            hits.append(flat)
            met.append(sorted(ids))
    return counts, hits, met


def _covered(spans: Column) -> Column:
    """Words in the union of intervals."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.greatest(p["end"] - F.greatest(p["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], p["end"]).alias("end")),
        lambda acc: acc["n"],
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_chars: int = ITEM_CHARS, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_words, n_hit long, hits array<struct<start, end>> (of hit words), items array<string>.

    The items' texts go to the tasks up to `item_chars` characters together; a larger benchmark is
    dealt into automata of about that size, past each of which the documents stream in turn. Then
    each pass leaves only the rows that it hits, and the documents are written once and joined with those.
    Only a run of words that all occur in the items can reach a window's length, so no other run
    is streamed. Null and empty texts have no words and no hits; items without words match nothing;
    an item without id counts for hits and is not listed. Repeated items and documents give what
    each gives alone. Without further automata, no shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    automata = max(1, math.ceil(chars / item_chars))
    keep = [c for c in keep if c not in ("n_words", "n_hit", "hits", "items")]

    def passed(df: DataFrame, columns: Sequence[str], i: int) -> DataFrame:
        mine = tuple((r.item, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(automata)) == i).collect())

        def factory():
            built = _built(mine, window)

            def kernel(texts):
                counts, hits, met = _scan(texts, built)
                return pa.array(counts, pa.int64()), pa.array(hits, _SPANS), pa.array(met, pa.list_(pa.string()))

            return kernel

        return map_text(df, "n_words long, __hits array<struct<start: int, end: int>>, __items array<string>", factory, text, columns)

    if automata == 1:
        found = passed(docs, keep, 0)
    else:
        own = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__own_text")) if text not in keep else docs.select(*keep)
        text = "__own_text" if text not in keep else text
        rows = stored(own.withColumn("__row", F.monotonically_increasing_id()), "documents")
        some = None
        for i in range(automata):
            hit = passed(rows, ["__row"], i).where((F.size("__hits") > 0) | (F.lit(i) == 0))
            hit = stored(hit if i == 0 else hit.drop("n_words"), "hits")
            some = hit if some is None else some.unionByName(hit, allowMissingColumns=True)
        each = some.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("__hits")).alias("__hits"), F.flatten(F.collect_list("__items")).alias("__items"))
        found = rows.select("__row", *keep).join(each, "__row")
    met = F.array_sort(F.array_distinct("__items"))
    return found.select(*keep, "n_words", _covered(F.col("__hits")).alias("n_hit"), F.col("__hits").alias("hits"), met.alias("items"))


def without_hits(text: Column | str, hits: Column | str) -> Column:
    """The text without the words of its hits, each with the characters between it and the word before it. A text without hits is unchanged.

    All hits are complete windows, or whole items shorter than one.
    """
    text, hits = F.col(text) if isinstance(text, str) else text, F.col(hits) if isinstance(hits, str) else hits
    word = r"A-Za-z0-9\x{80}-\x{10FFFF}"  # as ALNUM has it
    parts = F.regexp_extract_all(text, F.lit(f"[^{word}]*[{word}]+"), F.lit(0))
    kept = F.filter(parts, lambda _, i: ~F.exists(hits, lambda h: (h["start"] <= i) & (i < h["end"])))
    return F.when(F.size(hits) > 0, F.concat(F.array_join(kept, ""), F.regexp_extract(text, f"[^{word}]*$", 0))).otherwise(text)


def contaminated() -> Column:
    """The verdict on a row of find_contamination(): a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
