"""Removal of passages that an earlier document has: suffix automata of shards of reference text.

Which text is a reference, and which text is to be matched with which, is found by fingerprints. Every
window of words selects the least hash of the half-windows in it, so that equal windows select the
same one, wherever they stand; half-windows that one document alone selects rule out all windows
that select them. The windows that are left are grouped by hash: the first place of each group, in
its smallest document, is the reference of the others. The stretches of words that such windows cover
are cut out of the documents, so that no other text travels. References are dealt into shards of
bounded size; a shard's automaton goes to as many tasks as there is text for it, and stretches of
documents stream past it. Where the matching statistics reach the window's length in a smaller
document, the maximal span that they cover is removed. So fingerprints only choose whom to
match: spans come from the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import discard, map_text, parts, small, stored
from .wordhash import U64, binary, many, packs, windows

#: Words of a window.
WINDOW = 50
#: Words of reference text in one automaton, about (some 50 MB in a worker); words of one document in a shard; bytes of text that stream past one copy of it, about.
SHARD_WORDS, BLOCK_WORDS, TASK_BYTES = 100_000, 20_000, 16 << 20
#: Documents that select a half-window from which on it is hot: its windows are counted in each task before they are dealt.
HOT = 5000
#: Selected half-windows, and documents with spans, that are sent to every task at most; more are joined by a shuffle.
BROADCAST_ANCHORS, BROADCAST_DOCS = 2_000_000, 500_000


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


def _selected(texts: list[bytes | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its words, and of the half-window that each of its windows selects."""
    half = max(1, window // 2)
    for lo, hi in packs(texts):
        h, _, _, first, _ = many(texts[lo:hi])
        grams = windows(h, half)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield h[a:b], _sliding_min(grams[a : b - half + 1], window - half + 1) if b - a >= window else np.empty(0, U64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def candidate_windows(docs: DataFrame, window: int, broadcast_anchors: int) -> DataFrame:
    """(doc, h, at, more, hot): hash and first place of each window of a document whose half-window some other document selects too.

    `more` has the window's further places in the document, null if there are none; it is `hot` if more than HOT documents select
    its half-window. So a window's rows are no more than its documents, however often one repeats it.
    """

    def anchors(texts):
        return [[_signed(np.unique(s)) for _, s in _selected(texts, window)]]

    every = map_text(docs, "anchors array<long>", lambda: anchors, "text", ["doc"]).where(F.size("anchors") > 0)
    pairs = every.select("doc", F.explode("anchors").alias("anchor"))
    common = pairs.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = stored(common.select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")
    made = "wins array<struct<h: long, at: int, more: array<int>, hot: boolean>>"

    def found(texts: list[bytes | None], known: Sequence[np.ndarray], hot: Sequence[np.ndarray]) -> list[pa.Array]:
        """The windows of each text that its known half-windows are selected in."""
        sizes, hashes, places, marks, more = [0], [], [], [], []
        for (h, s), k, x in zip(_selected(texts, window), known, hot, strict=True):
            s = _signed(s)
            at = np.flatnonzero(_among(s, k))
            if not len(at):
                sizes.append(0)
                continue
            keys, first, own = np.unique(_signed(windows(h, window))[at], return_index=True, return_inverse=True)
            sizes.append(len(keys))
            hashes.append(keys)
            places.append(at[first].astype(np.int32))
            marks.append(_among(s[at[first]], x))
            rest: list[list[int] | None] = [None] * len(keys)
            if len(keys) < len(at):
                again = np.ones(len(at), bool)
                again[first] = False
                for i, p in zip(own[again].tolist(), at[again].tolist(), strict=True):
                    if rest[i] is None:
                        rest[i] = []
                    rest[i].append(p)
            more += rest
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, kind)) for c, kind in ((hashes, np.int64), (places, np.int32), (marks, bool))]
        columns.insert(2, pa.array(more, pa.list_(pa.int32())))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(columns, names=["h", "at", "more", "hot"]))]

    if small(shared, broadcast_anchors):
        table = shared.toArrow()
        known = np.sort(table["anchor"].to_numpy())
        hot = np.sort(table["anchor"].filter(table["hot"]).to_numpy())

        def kernel(texts):
            return found(texts, [known] * len(texts), [hot] * len(texts))

        wins = map_text(docs, made, lambda: kernel, "text", ["doc"])
    else:
        mine = pairs.join(shared, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("known"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))

        def kernel(texts, *own):
            return found(texts, *[[np.unique(np.array(x, np.int64)) for x in c.to_pylist()] for c in own])

        wins = map_text(docs.join(mine, "doc"), made, lambda: kernel, "text", ["doc"], ["known", "hot"])
    return wins.select("doc", F.explode("wins").alias("w")).select("doc", "w.*")


def _with_firsts(wins: DataFrame) -> DataFrame:
    """wins with `first`, the smallest (doc, at) of those of its hash, and `last`, the largest document.

    Windows of few documents are dealt by their hash once. Those that are in very many are counted in
    every task before they are dealt, and joined with what comes of that, which is stored, so that one
    key may go to several tasks. A window is of either sort with all others of its hash.
    """
    first, last = F.min(F.struct("doc", "at")), F.max("doc")
    group = Window.partitionBy("h")
    few = wins.where("not hot").select("doc", "h", "at", "more", first.over(group).alias("first"), last.over(group).alias("last"))
    many = wins.where("hot").select("doc", "h", "at", "more")
    known = stored(many.groupBy("h").agg(first.alias("first"), last.alias("last")), "firsts")
    return few.unionByName(many.join(known, "h"))


class Shard:
    """The automaton of stretches of words of several documents."""

    def __init__(self, stretches: Iterator[tuple[object, bytes]]) -> None:
        self.automaton = SuffixAutomaton()
        for owner, text in stretches:
            self.automaton.add(text.split(), owner)
        self.automaton.finish()

    def covered(self, words: list[bytes], owner: object, window: int) -> list[tuple[int, int]]:
        """Maximal spans of words that windows of documents smaller than the owner cover."""
        spans: list[list[int]] = []
        least = self.automaton.least
        for i, (v, n) in enumerate(self.automaton.match(words, window), 1):
            if n >= window and least[v] < owner:
                if spans and spans[-1][1] >= i - window:
                    spans[-1][1] = i
                else:
                    spans.append([i - window, i])
        return [(a, b) for a, b in spans]


def _runs(places: str, window: int) -> Column:
    """array<struct<start, end>>: stretches of words that windows at the sorted places of a column cover."""
    at = F.col(places)
    starts = F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + window))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + window))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + window).alias("end")))


def _matched(window: int):
    """Streams stretches sorted by shard, each shard's references before the documents' text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, references, shard = None, [], None
        for batch in batches:
            for part in parts(batch, ["words"]):
                docs, spans = [], []
                columns = [part.column(c).to_pylist() for c in ("shard", "salt", "streams", "doc", "start")]
                for at, salt, streams, doc, start, words in zip(*columns, binary(part.column("words")), strict=True):
                    if place != (at, salt):
                        place, references, shard = (at, salt), [], None
                    if not streams:
                        references.append((doc, words))
                        continue
                    if shard is None:
                        shard, references = Shard(references), []
                    if found := shard.covered(words.split(), doc, window):
                        docs.append(doc)
                        spans.append([{"start": start + a, "end": start + b} for a, b in found])
                yield pa.RecordBatch.from_arrays([pa.array(docs, part.column("doc").type), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc", "spans"])

    return run


def _stretches(docs: DataFrame, wins: DataFrame, window: int) -> DataFrame:
    """A stored table (shard, streams, doc, start, words): references, and what streams past them, as text.

    A reference is a stretch of the smallest document that has its windows, and belongs to the shard of
    its document and block of words; the later documents' stretches go to the shards of their windows.
    """
    block = F.floor(F.col("first.at") / BLOCK_WORDS)
    placed = stored(_with_firsts(wins).where("first.doc < last and (first.doc < doc or first.at = at)").select("doc", "at", "more", F.col("first.doc").alias("first"), block.alias("block")), "placed")
    shards = max(1, math.ceil(placed.where("first = doc").count() / SHARD_WORDS))
    shard = F.pmod(F.xxhash64("first", "block"), F.lit(shards)).cast("int").alias("shard")
    wanted = placed.groupBy("doc", shard, (F.col("first") < F.col("doc")).alias("streams")).agg(F.sort_array(F.concat(F.collect_list("at"), F.flatten(F.collect_list("more")))).alias("at"))
    wanted = wanted.select("doc", "shard", "streams", _runs("at", window).alias("runs"))
    wanted = stored(wanted.groupBy("doc").agg(F.collect_list(F.struct("shard", "streams", "runs")).alias("wanted")), "wanted")
    few = small(wanted, BROADCAST_DOCS, F.aggregate("wanted", F.lit(0).cast("long"), lambda n, x: n + F.size(x["runs"]) * 16 + 32))
    joined = docs.join(F.broadcast(wanted) if few else wanted, "doc")

    def kernel(texts, wanted):
        out = []
        for t, some in zip(texts, wanted.to_pylist(), strict=True):
            words = t.split()
            out.append([{"shard": x["shard"], "streams": x["streams"], "start": r["start"], "words": b" ".join(words[r["start"] : r["end"]])} for x in some for r in x["runs"]])
        return [pa.array(out, pa.list_(pa.struct([("shard", pa.int32()), ("streams", pa.bool_()), ("start", pa.int32()), ("words", pa.binary())]))).cast(_CUT)]

    cut = map_text(joined, "cut array<struct<shard: int, streams: boolean, start: int, words: string>>", lambda: kernel, "text", ["doc"], ["wanted"])
    stretches = stored(cut.select("doc", F.explode("cut").alias("c")).select("doc", "c.*"), "stretches")
    discard(docs.sparkSession, placed, wanted)
    return stretches


_CUT = pa.list_(pa.struct([("shard", pa.int32()), ("streams", pa.bool_()), ("start", pa.int32()), ("words", pa.string())]))


def repeated_spans(docs: DataFrame, window: int = WINDOW, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """(doc, spans), stored, for a table (doc, text): the words that windows of smaller documents cover."""
    wins = stored(candidate_windows(docs, window, broadcast_anchors), "windows")
    cut = _stretches(docs, wins, window)
    # a shard past which much text streams has copies, each with a part of it
    copies = stored(cut.where("streams").groupBy("shard").agg(F.ceil(F.sum(F.length("words").cast("long")) / TASK_BYTES).cast("int").alias("copies")), "copies")
    streams = cut.where("streams").join(copies, "shard").withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.col("copies")).cast("int"))
    references = cut.where("not streams").join(copies, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    tasks = streams.unionByName(references).drop("copies").repartition("shard", "salt").sortWithinPartitions("shard", "salt", "streams")
    matched = tasks.mapInArrow(_matched(window), f"doc {docs.schema['doc'].dataType.simpleString()}, spans array<struct<start: int, end: int>>")
    spans = stored(matched.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(docs.sparkSession, wins, cut, copies)
    return spans


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """One row for each row of docs: its id, n_words, n_removed (long), kept string (words joined by a space), removed array<struct<start, end>>.

    Words are what stands between spaces, tabs and line ends, unchanged. Null and empty texts, and
    texts of fewer words than a window, keep all words. A row of null id is nobody's reference and
    keeps all words. Rows of one id are one document: none is a repeat of the others.
    """
    named = docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text"))
    spans = repeated_spans(named.where("doc is not null and text is not null"), window, broadcast_anchors)
    joined = named.join(F.broadcast(spans) if small(spans, BROADCAST_DOCS, F.size("spans") * 16) else spans, "doc", "left")

    def kernel(texts, spans):
        total, gone, kept, removed = [], [], [], []
        for t, found in zip(texts, spans.to_pylist(), strict=True):
            words = (t or b"").split()
            left, cut, at = [], [], 0
            for x in sorted(found or (), key=lambda x: x["start"]):
                a, b = max(x["start"], at), min(x["end"], len(words))
                if a < b:
                    left += words[at:a]
                    if cut and cut[-1]["end"] == a:
                        cut[-1]["end"] = b
                    else:
                        cut.append({"start": a, "end": b})
                    at = b
            left += words[at:]
            total.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
            removed.append(cut)
        return total, gone, pa.array(kept, pa.binary()).cast(pa.string()), removed

    made = "n_words long, n_removed long, kept string, removed array<struct<start: int, end: int>>"
    return map_text(joined, made, lambda: kernel, "text", ["doc"], ["spans"]).withColumnRenamed("doc", id)
