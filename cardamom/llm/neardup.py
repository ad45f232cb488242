"""Near-duplicate documents by an inverted join of MinHash signatures.

Documents of equal shingle sets are one class, and a class is one entry of the join. Each
class posts itself under its rarest signature coordinates: with K coordinates, of which two
signatures must share T, two such signatures share one of the K - T + 1 rarest of either, in
any fixed order. The commoner coordinates of a signature are skipped; pairs that meet are
merged, that is, all their coordinates are compared, and pairs with T matches or more are
confirmed on their full sets of shingles.

Only components are asked for, so a posting list isn't expanded into all its pairs. Its
members first meet its smallest member, then a fixed number of leaders, one for each value of
a hash, unless they are in their component by then. In a list of few members these are all
pairs. Of longer lists that still span components, the documents meet once more, by the shingles
themselves: rare ones first, a set of n shingles is posted under n - ceil(0.75 n) + 1 of them,
and pairs of one component, or of sizes too far apart, are never made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_text, parts, returning, small, stored
from .components import connected
from .wordhash import U64, binary, many, packs, windows

#: Words of a shingle; the least similarity, as hundredths.
SHINGLE, SIMILAR = 5, 75
#: Coordinates of a signature, and how many must match. A pair of similarity 0.75 fails the match count
#: once in 500,000 times, one of 0.8 once in 10**8.
COORDINATES, MATCHES = 48, 22
#: Leaders of a posting list at most.
LEADERS = 4
#: Members of a list that meet in one task at most; longer lists are cut into blocks, which meet pairwise.
MEETING = 1000
#: Ids that are sent to every task to filter documents, at most (some 30 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(48611)
_A = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles: its runs of n words, or all its words if they are fewer."""
    for lo, hi in packs(texts):
        h, _, _, first, _ = many([(t or b"").lower() for t in texts[lo:hi]])
        every = windows(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(every[a : b - n + 1]) if b - a >= n else windows(h[a:b], b - a) if b > a else np.empty(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash function over the shingles."""
    best = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 2048):
        h = shingles[at : at + 2048, None] * _A + _B
        np.minimum(best, (h.min(0) >> U64(32)).astype(np.uint32), out=best)
    return best


def signatures(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_shingles long, class binary (a digest of the set of shingles), sig binary; the last two null for empty sets."""

    def factory():
        def kernel(texts):
            sizes, classes, sigs = [], [], []
            for s in shingle_sets(texts):
                sizes.append(len(s))
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            return sizes, classes, sigs

        return kernel

    return map_text(docs, "n_shingles long, class binary, sig binary", factory, text, keep)


def _coordinate(sig: str, j: Column) -> Column:
    return F.substring(F.col(sig), j * 4 + 1, F.lit(4))


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(p, rep): each class under those of its rarest coordinates that another class has too."""
    every = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda j: F.xxhash64(j, _coordinate("sig", j)))
    entries = classes.select("rep", F.explode(every).alias("p"))
    # stored, as all that a hot coordinate's rows are joined with: such a join may deal one key to several tasks
    common = stored(entries.groupBy("p").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    held = entries.join(common, "p").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "p"))).alias("held"))
    # coordinates that no other class has are rarer than all of these
    left = F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("held"))
    return held.where(left > 0).select("rep", F.explode(F.slice("held", F.lit(1), F.greatest(left, F.lit(1)))).alias("x")).select(F.col("x.p").alias("p"), "rep")


def _merged(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose signatures have enough coordinates in common."""
    one = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda j: _coordinate("sig_a", j) == _coordinate("sig_b", j)))
    return pairs.join(two, "b").join(one, "a").where(same >= matches).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, id: str, text: str, n: int, similar: int) -> DataFrame:
    """Pairs (a, b) of `pairs`, a stored table, that are similar on their full sets."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    few = small(ids, BROADCAST_IDS)
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    full = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, ["text_a", "text_b"]):
                keep = []
                for x, y in zip(*(shingle_sets(binary(part.column(c)), n) for c in ("text_a", "text_b")), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= similar * (len(x) + len(y) - shared) and shared > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "text_a", "text_b").mapInArrow(returning(run), pairs.select("a", "b").schema)


def _last_round(left: DataFrame, docs: DataFrame, id: str, text: str, n: int, similar: int) -> DataFrame:
    """Pairs (a, b) of documents of `left` (rep, c), of different components, that the prefixes of their sets don't rule out."""
    few = small(left, BROADCAST_IDS)
    named = docs.select(F.col(id).alias("rep"), F.col(text).cast("string").alias("text")).join(F.broadcast(left) if few else left, "rep")

    def kernel(texts):
        return [[s.astype(np.int64) for s in shingle_sets(texts, n)]]

    # a repeated row only lengthens prefixes
    sets = map_text(named, "g array<long>", lambda: kernel, "text", ["rep", "c"])
    each = stored(sets.select("rep", "c", F.size("g").alias("n"), F.explode("g").alias("g")), "shingles")
    common = stored(each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    held = each.join(common, "g").groupBy("rep", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("held"))
    # shingles that no other of these documents has are rarer than all of these
    reach = F.col("n") - F.ceil(F.col("n") * F.lit(similar) / 100) + 1 - (F.col("n") - F.size("held"))
    prefix = held.where(reach > 0).select("rep", "c", "n", (F.col("n") - F.size("held")).alias("rarer"), F.posexplode(F.slice("held", F.lit(1), F.greatest(reach, F.lit(1)).cast("int"))).alias("i", "x"))
    posted = stored(prefix.select("rep", "c", "n", (F.col("rarer") + F.col("i")).alias("i"), F.col("x.g").alias("g")), "prefixes")
    return _met(posted, similar)


def _met(posted: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of different components in the lists of a stored table (g, rep, c, n, i).

    Similar sets are of sizes at most a step apart, so a list falls into cells of such sizes; a member
    stands in its own cell and meets those that stand in it or in a cell beside it. A cell of many
    members is cut into blocks, and each pair of blocks is a key of its own.
    """
    sizes = stored(posted.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("components")).where("components > 1").select("g", "most"), "lists")
    # a little wider than the step, for the sake of rounding
    step = math.log(100 / similar) * 1.0001 if similar < 100 else 1e-3
    lists = stored(posted.join(sizes, "g").withColumn("cell", F.floor(F.log(F.col("n")) / F.lit(step)).cast("int")), "members")
    # members of a list's largest component meet the others, and those each other
    a = lists.where("c != most")
    b = lists.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    count = a.groupBy("g", "cell").agg(F.count("*").alias("na")).join(b.groupBy("g", "cell").agg(F.count("*").alias("nb")), ["g", "cell"])
    cells = stored(count.select("g", "cell", F.ceil(F.col("na") / MEETING).cast("int").alias("ka"), F.ceil(F.col("nb") / MEETING).cast("int").alias("kb")), "cells")

    def block(k: str):
        return F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")

    def all_blocks(k: str):
        return F.explode(F.sequence(F.lit(0), F.col(k) - 1))

    a = a.join(cells, ["g", "cell"]).select("g", "cell", block("ka").alias("ba"), all_blocks("kb").alias("bb"), F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    b = b.join(cells, ["g", "cell"]).select("g", "cell", all_blocks("ka").alias("ba"), block("kb").alias("bb"), F.col("rep").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("i").alias("iy"), "most")
    # so many shingles two similar sets of these sizes share; before the first of them stand no more than the rest
    shared = F.ceil(similar * (F.col("nx") + F.col("ny")) / (100 + similar))
    first = (F.col("ix") <= F.col("nx") - shared) & (F.col("iy") <= F.col("ny") - shared)
    near = (100 * F.least("nx", "ny") >= similar * F.greatest("nx", "ny")) & first & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("most")) | (F.col("x") < F.col("y")))
    return a.join(b, ["g", "cell", "ba", "bb"]).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def find_components(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, similar: int = SIMILAR, matches: int = MATCHES) -> DataFrame:
    """One row for each row of docs: its id, n_shingles, component_id and kept (the id is the component's smallest).

    A null or empty text has no shingles and is linked with nothing. A row of null id takes its
    component from its class, is never kept beside another row of it, and has a null component if no
    row of its class has an id. Rows of one id and text are one document.
    """
    spark = docs.sparkSession
    rows = stored(signatures(docs, text, [id]).withColumnRenamed(id, "id"), "signatures")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")).where("rep is not null")
    classes = stored(classes, "classes")
    posted = stored(postings(classes, matches), "postings")

    def compared(pairs: DataFrame) -> DataFrame:
        met = stored(_merged(pairs, classes, matches), "pairs")
        links = stored(_confirmed(met, docs, id, text, n, similar), "links")
        discard(spark, met)
        return links

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """(rep, c): the components that the links make of those so far."""
        ends = [labels.select(F.col("rep").alias(e), F.col("c").alias(f"c{e}")) for e in ("a", "b")]
        known = connected(links.join(ends[0], "a").join(ends[1], "b").select("ca", "cb").distinct(), "ca", "cb")
        return stored(labels.join(known.withColumnRenamed("id", "c"), "c", "left").select("rep", F.coalesce("component", "c").alias("c")), "components")

    lists = stored(posted.groupBy("p").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "lists")
    labels = joined(classes.select("rep", F.col("rep").alias("c")), compared(posted.join(lists, "p").where("rep != a").select("a", F.col("rep").alias("b")).distinct()))
    # the lists' leaders, for members of other components
    now = stored(posted.join(labels, "rep"), "placed")
    leaders = now.groupBy("p", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)).alias("slot")).agg(F.min_by(F.struct("rep", "c"), "rep").alias("x"))
    leaders = stored(leaders.select("p", F.col("x.rep").alias("leader"), F.col("x.c").alias("cl")), "leaders")
    more = now.join(leaders, "p").where("c != cl").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    labels = joined(labels, compared(more))
    # longer lists that still hold more than one component
    now = stored(posted.join(labels, "rep"), "placed")
    led = leaders.groupBy("p").agg(F.count("*").alias("k"))
    mixed = stored(now.groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).join(led, "p").where("low < high and n > k + 1").select("p"), "mixed")
    left = stored(now.join(mixed, "p").select("rep", "c").distinct(), "left")
    if left.limit(1).count():
        labels = joined(labels, compared(_last_round(left, docs, id, text, n, similar)))
    discard(spark, posted, lists, leaders, now, mixed)
    known = labels.select(F.col("rep").alias("id"), F.col("c").alias("component"))
    found = classes.select("class", "rep").join(known.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    result = rows.select("id", "n_shingles", "class").join(found, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return result.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
