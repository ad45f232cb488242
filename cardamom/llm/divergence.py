"""How the words of sources differ from those of their language, counted behind a sketch.

Two passes over the texts. The first makes a count-min sketch of document frequencies: each task adds
its documents to a sketch of its own, the tasks' sketches are added up, in two steps so that no
task adds up all of them, and all that is kept of a cell is whether it reached the least
frequency. An estimate is never below the true frequency, so a term with a cell that didn't reach it is
impossible. The second pass counts terms in each task, drops impossible ones before anything is
shuffled, and counts the others exactly; those whose exact frequency is too low go then.

Sums over all kept terms come from sparse counts: a term that neither source has adds the same
for every term, one that a single source has depends on that source's count alone, and only terms that
both have are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, spread
from .common import parts, stored
from .wordhash import binary

#: A term is kept if this many documents of its language have it.
LEAST_DOCS = 10
#: Rows of the sketch, cells of a row, cells of a block.
DEPTH, WIDTH, BLOCK = 4, 1 << 20, 1 << 16
#: Distinct terms that a task holds before it gives them on.
HELD = 400_000
#: Parts into which the tasks' sketches are dealt before they are added up.
FAN = 64
#: Terms at the top of a group's list.
TOP = 10

# ASCII other than letters parts terms; A-Z become a-z; all other bytes belong to characters beyond ASCII.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, lower-cased, and characters beyond ASCII."""
    return text.translate(_TO_TERMS).split()


def cells(lang: str, words: Sequence[bytes], depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Row by row the cells of a language's terms."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8"))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * high) % np.uint64(width)).astype(np.int64) + i * width for i in range(depth)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for batch in batches:
        for part in parts(batch, ["text"]):
            yield from zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), (t or b"" for t in binary(part.column("text"))), strict=True)


def _sketched(batches: Iterator[pa.RecordBatch], least: int, depth: int, width: int) -> Iterator[pa.RecordBatch]:
    """The sketch of a task's documents as blocks (block, counts up to `least`, packed)."""
    sketch = np.zeros(depth * width, np.uint32)
    found: dict[str, Counter] = {}
    held = 0

    def add() -> None:
        for lang, docs in found.items():
            at, n = cells(lang, list(docs), depth, width), np.fromiter(docs.values(), np.uint32, len(docs))
            for row in at:
                np.add.at(sketch, row, n)
        found.clear()
        np.minimum(sketch, least, out=sketch)

    for lang, _, text in _texts(batches):
        mine = found.setdefault(lang, Counter())
        before = len(mine)
        mine.update(set(terms(text)))
        held += len(mine) - before
        if held >= HELD:
            add()
            held = 0
    add()
    yield from _blocks(sketch)


def _blocks(sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, block in enumerate(np.split(sketch, range(BLOCK, len(sketch), BLOCK))):
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _added(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The sums of a task's blocks, up to `least`. It has no more than one sketch in memory."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), np.uint32)
            sums[i] = np.minimum(sums[i] + counts, least) if i in sums else counts
    for i, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _reached(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = [np.packbits(np.frombuffer(zlib.decompress(x), np.uint32) >= least).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["block", "bits"])


def possible(docs: DataFrame, least: int, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Bits of the merged sketch: whether a cell's documents are `least` or more. depth * width / 8 bytes (half a megabyte), whatever the input."""
    schema = "block int, counts binary"
    own = docs.mapInArrow(lambda b: _sketched(b, least, depth, width), schema)
    some = own.repartition("block", F.pmod(F.spark_partition_id(), F.lit(FAN))).mapInArrow(lambda b: _added(b, least), schema)
    whole = some.repartition("block").mapInArrow(lambda b: _added(b, least), schema)
    bits = np.zeros(-(-depth * width // 8), np.uint8)
    for r in whole.mapInArrow(lambda b: _reached(b, least), "block int, bits binary").collect():
        at, some_bits = r["block"] * BLOCK // 8, np.frombuffer(r["bits"], np.uint8)
        bits[at : at + len(some_bits)] = some_bits
    return bits


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray, depth: int, width: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, without impossible terms."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            words = list(own)
            at = cells(lang, words, depth, width)
            ok = np.logical_and.reduce((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            left = [w for w, x in zip(words, ok.tolist(), strict=True) if x]
            of = docs[lang, source]
            columns = [pa.array([lang] * len(left), pa.string()), pa.array([source] * len(left), pa.string()), pa.array([w.decode("utf-8", "replace") for w in left], pa.string()), pa.array([own[w] for w in left], pa.int64()), pa.array([of[w] for w in left], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for lang, source, text in _texts(batches):
        words = terms(text)
        own = n.setdefault((lang, source), Counter())
        before = len(own)
        own.update(words)
        docs.setdefault((lang, source), Counter()).update(set(words))
        held += len(own) - before
        if held >= HELD:
            yield from give()
            held = 0
    yield from give()


def _texts_of(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return spread(docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(lang, source, term, n): occurrences of terms that `least` documents of the language have, exactly. A stored table."""
    texts = _texts_of(docs)
    bits = docs.sparkSession.sparkContext.broadcast(possible(texts, least, depth, width))
    own = texts.mapInArrow(lambda b: _counted(b, bits.value, depth, width), "lang string, source string, term string, n long, docs long")
    sums = own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(sums, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("d")).where(F.col("d") >= least).select("lang", "term")
    return stored(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept")


def _p(n: Column | str, total: str, size: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * size)), exactly: counts beyond 9 * 10^9 exceed a long's range when multiplied."""
    over = F.expr(f"nullif(cast({total} as decimal(20,0)) + 2 * cast({size} as decimal(20,0)), 0)")
    n = F.col(n) if isinstance(n, str) else n
    scaled = (n.cast("decimal(20,0)") + F.lit(2).cast("decimal(20,0)")) * F.lit(10**9).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, over).cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang string, source string, part string, item string, value long, rank int.

    Part `pair`: how far the term frequencies of a source are from those of each other source of its
    language, summed over all kept terms. Part `term`: the `top` kept terms that stand out most in a
    source against its language. Ranks begin at 1 in each group and part, ties go to the item that comes first
    in UTF-8.

    Null text, lang and source are ''. Repeated rows are documents of their own. A group without terms
    has its pairs; a language without kept terms has pairs of value 0; an empty table gives no rows. Texts of any
    length are counted whole. Other columns take no part.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = kept_counts(docs, least)
    of_term = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("ln")), "terms")
    of_lang = of_term.groupBy("lang").agg(F.count("*").alias("size"), F.sum("ln").alias("ltotal"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    known = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    known = known.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "size", "ltotal")])
    known = stored(known.withColumn("p0", _p(zero, "total", "size")), "groups")
    rows = stored(counts.join(known, ["lang", "source"]).join(of_term, ["lang", "term"]).select("lang", "source", "term", "p0", _p("n", "total", "size").alias("p"), _p("ln", "ltotal", "size").alias("lp")), "probabilities")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    standing = rows.where("p > lp").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "lp").alias("value"))
    standing = standing.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    a, b = (known.select("lang", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "p0")], *([F.col("size")] if k == "a" else [])) for k in "ab")
    pairs = stored(a.join(b, "lang").where("source_a != source_b"), "pairs")
    # terms that both sources have: what they add beyond the two single terms; f is symmetric
    mine, other = (rows.select("lang", "term", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "p0", "p")]) for k in "ab")
    both = mine.join(other, ["lang", "term"]).where("source_a < source_b")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(_f("p_a", "p_b") - _f("p_a", "p0_b") - _f("p0_a", "p_b") + _f("p0_a", "p0_b")).alias("both"))
    # each source's terms against a source that hasn't them, by the different values of p
    single = rows.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a")).agg(F.count("*").alias("n"))
    single = pairs.join(single, ["lang", "source_a"]).groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("n") * (_f("p_a", "p0_b") - _f("p0_a", "p0_b"))).alias("own"))
    single = stored(single, "single")
    turned = single.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), F.col("own").alias("others"))
    both = stored(both, "both")
    both = both.unionByName(both.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "both"))
    key = ["lang", "source_a", "source_b"]
    summed = pairs.join(single, key, "left").join(turned, key, "left").join(both, key, "left")
    value = F.when(F.col("size") > 0, F.col("size") * _f("p0_a", "p0_b")).otherwise(zero) + F.coalesce("own", zero) + F.coalesce("others", zero) + F.coalesce("both", zero)
    far = summed.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    far = far.withColumn("rank", F.row_number().over(best))
    return far.unionByName(standing)
