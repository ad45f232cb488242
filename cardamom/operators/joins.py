"""Joins: pending and orphans, foreign keys, prefixes, patterns, near-duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shingle_hashes, tokens
from ..session import ship, spread, stored


def pending(cards: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Cards without an annotation."""
    return cards.join(annotations.select(key), key, "left_anti")


def pending_images(cards: DataFrame, annotations: DataFrame, key: str, images: Column, flag: str) -> DataFrame:
    """Cards with images whose image flag is neither true nor false, annotated or not."""
    return cards.where(images > 0).join(annotations.select(key, flag), key, "left").where(F.col(flag).isNull()).drop(flag)


def orphans(annotations: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Annotations without a card: an integrity error, if there are any."""
    return annotations.join(cards.select(key), key, "left_anti")


def key_errors(rows: DataFrame, dim: DataFrame, key: str, attribute: str | None = None) -> DataFrame:
    """Rows whose key is unknown, or whose attribute isn't the dimension's, with the error."""
    side = dim.select(key, F.lit(True).alias("__known"), *([F.col(attribute).alias("__want")] if attribute else []))
    joined = rows.join(side, key, "left")
    error = F.when(F.col("__known").isNull(), F.lit("unknown key"))
    if attribute:
        error = error.when(~F.col(attribute).eqNullSafe(F.col("__want")), F.lit("attribute differs"))
    return joined.withColumn("error", error).where("error is not null").select(*rows.columns, "error")


def in_scope(rules: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return rules.join(scope.select(key), key, "left_semi")


def unknown_scope(rules: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return scope.join(rules.select(key), key, "left_anti")


def prefixes(name: Column, separators: str) -> Column:
    """The name, and every part of it that ends before a separator, longest first."""
    ends = F.filter(F.sequence(F.length(name), F.lit(1), F.lit(-1)), lambda i: (i == F.length(name)) | F.position(F.substring(name, i + 1, F.lit(1)), F.lit(separators)).cast("boolean"))
    return F.transform(ends, lambda i: F.left(name, i))


def longest_prefix(rows: DataFrame, prices: DataFrame, name: str, key: str, separators: str = "-:/@.") -> DataFrame:
    """rows with the price row whose key is the name, or the longest beginning of it that a separator ends; nulls if none.

    Each distinct name is exploded into its beginnings and joined on equality; no nested loop.
    """
    names = rows.select(name).where(F.col(name) != "").distinct()
    tried = names.select(name, F.posexplode(prefixes(F.col(name), separators)).alias("__at", key))
    rest = [c for c in prices.columns if c != key]
    best = tried.join(prices, key).groupBy(name).agg(F.min_by(F.struct(key, *rest), "__at").alias("__best"))
    return rows.join(best, name, "left").select(*rows.columns, F.col(f"__best.{key}").alias(key), *[F.col(f"__best.{c}").alias(c) for c in rest])


def source_of(ids: DataFrame, id: str, sources: DataFrame, source: str) -> DataFrame:
    """ids with the first source, in sorted order, that the id begins with before a '_'.

    Beginnings that end at a '_' are joined on equality, as in longest_prefix().
    """
    tried = ids.select(id).distinct().select(id, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(id, "_")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split(id, "_"), F.lit(1), n), "_"))).alias(source))
    best = tried.join(sources.select(source), source).groupBy(id).agg(F.min(source).alias(source))
    return ids.join(best, id, "left")


#: Shingles of the other side that are sent to every task at most; more meet by the inverted index.
BROADCAST_GRAMS = 1_000_000
#: Numbers of rows that are sent to every task to filter sets, at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: One in so many different sets is read to tell frequent shingles from rare ones, and so many cells tell them (a power of two).
SAMPLED, LEVELS = 8, 1 << 20
#: Sets that a task puts in order or sketches at once, and the bits of a sketch (a power of two).
PREFIX_ROWS, SKETCH_BITS = 512, 1024


def near_duplicates(docs: DataFrame, key: str, text: str, k: int = 5, above: float = 0.7, other: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of pairs of texts whose shingles' Jaccard similarity is above a bound, strictly.

    Texts of equal sets of shingles are one class, which is compared once. An inverted index with a
    prefix filter pairs classes: those of similarity above t share one of the first n - ceil(t * n) + 1
    of their n shingles, in any order of all shingles; here those that a sample shows to be frequent
    come last. Only these first ones travel. Texts without shingles never pair.
    With `other`, pairs of a text of docs and one of other; else pairs a < b of docs. Shingles of an
    `other` of up to BROADCAST_GRAMS go to the tasks, which count what each text shares with it.
    """
    both = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(0).alias("side"))
    if other is not None:
        both = both.unionByName(other.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(1).alias("side")))
        sets = spread(both).select("id", "side", shingle_hashes(tokens(F.col("text")), k).alias("s")).where(F.size("s") > 0)
        grams = sets.select("id", "side", F.size("s").alias("n"), F.explode("s").alias("g"))
        theirs = grams.where("side = 1").select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
        if theirs.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
            own = grams.where("side = 0").select(F.col("id").alias("a"), F.col("n").alias("na"), "g")
            inter = own.join(F.broadcast(theirs), "g").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
            return _similar(inter, above)
    members, classes = _classes(_sets(both, k))
    pairs = _near_classes(classes, above)
    a, b = (members.select(F.col("class").alias(f"c{x}"), F.col("id").alias(x), F.col("side").alias(f"s{x}")) for x in "ab")
    across = pairs.join(a, "ca").join(b, "cb")
    within = a.join(b, F.col("ca") == F.col("cb")).withColumn("similarity", F.lit(1.0))
    every = across.unionByName(within.select(across.columns))
    if other is not None:
        swapped = (F.col("sa") == 1) & (F.col("sb") == 0)
        turned = every.where(F.col("sa") != F.col("sb")).select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b"), "similarity")
        return turned.distinct()
    return every.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def near_duplicate_links(docs: DataFrame, key: str, text: str, k: int = 5, above: float = 0.7) -> DataFrame:
    """key, class, links: of each text the smallest key that has its very set of shingles, and how many other texts near_duplicates() pairs it with.

    One row for each row of docs, however many copies a text has: copies are counted, and no pair of them is made.
    Texts without shingles have no class and no links. Equal keys are rows of their own.
    """
    own = _sets(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(0).alias("side")), k)
    members, classes = _classes(own)
    pairs = _near_classes(classes, above)
    sizes = stored(members.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("least")), "sizes")
    turned = pairs.select("ca", "cb").unionByName(pairs.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    near = turned.join(sizes.select(F.col("class").alias("cb"), "n"), "cb").groupBy(F.col("ca").alias("class")).agg(F.sum("n").alias("others"))
    of_class = stored(sizes.join(near, "class", "left").select("class", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "links")
    linked = members.join(of_class, "class").select(F.col("id").alias(key), F.col("least").alias("class"), "links")
    alone = own.where("digest is null").select(F.col("id").alias(key), F.lit(None).cast(linked.schema["class"].dataType).alias("class"), F.lit(0).cast("long").alias("links"))
    return linked.unionByName(alone)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """A stored table (row, id, side, digest, s) of texts (id, text, side): sorted hashes of their shingles, and a digest of these, null if there are none.

    The one place that all shingles are written to; they are read from here, and shuffled no more.
    """
    sets = spread(texts).select("id", "side", F.array_sort(shingle_hashes(tokens(F.col("text")), k)).alias("s"))
    digest = F.when(F.size("s") > 0, F.struct(F.size("s").alias("n"), F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("i")))
    return stored(sets.select(F.monotonically_increasing_id().alias("row"), "id", "side", digest.alias("digest"), "s"), "sets")


def _without(table: DataFrame, rows: DataFrame, key: str, how: str) -> DataFrame:
    """table, less the rows that a semi or anti join with a stored table of keys leaves out; table stays where it is if these are few."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return table.join(F.broadcast(rows) if few else rows, key, how)


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a table that _sets() made: a stored table (id, side, class) of the rows that have shingles, and (class, n, s) of each different set."""
    some = sets.where("digest is not null")
    first = stored(some.groupBy("digest").agg(F.min("row").alias("class")), "classes")
    members = stored(some.select("row", "id", "side", "digest").join(first, "digest").select("row", "id", "side", "class"), "members")
    copies = members.where("row != class").select("row")
    return members.drop("row"), _without(some, copies, "row", "left_anti").select(F.col("row").alias("class"), F.col("digest.n").alias("n"), "s")


def _levels(classes: DataFrame) -> np.ndarray:
    """How frequent the shingles of each of LEVELS cells are at most, in eighths of a doubling, by a sample of the classes; 0 if they are rare.

    Of fixed size, whatever the input. It decides the order of shingles, and no result.
    """
    sample = classes.where(F.pmod(F.xxhash64("class"), F.lit(SAMPLED)) == 0)
    often = sample.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("df")).where("df > 2")
    cells = often.groupBy(F.pmod("g", F.lit(LEVELS)).cast("int").alias("cell")).agg(F.least(F.lit(255), F.floor(8 * F.log2(F.max("df")))).cast("int").alias("level")).toArrow()
    levels = np.zeros(LEVELS, np.uint8)
    levels[cells.column("cell").to_numpy()] = cells.column("level").to_numpy()
    return levels


def _prefixes(classes: DataFrame, above: float) -> DataFrame:
    """A stored table (class, n, i, g): the first n - ceil(above * n) + 1 shingles of each set of n with their places, rare cells first, then by hash."""
    ship(classes.sparkSession)
    levels, mask = _levels(classes), LEVELS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PREFIX_ROWS):
                part = batch.slice(at, PREFIX_ROWS)
                n = part.column("n").to_numpy().astype(np.int64)
                g = part.column("s").flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), n)
                # the hashes of a set are in order, which a stable sort keeps
                g = g[np.argsort(owner * 256 + levels[g & mask], kind="stable")]
                i = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
                kept = i < np.repeat(n - np.ceil(n * above).astype(np.int64) + 1, n)
                owner = owner[kept]
                made = [part.column("class").to_numpy()[owner], n[owner].astype(np.int32), i[kept].astype(np.int32), g[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["class", "n", "i", "g"])

    return stored(classes.select("class", "n", "s").mapInArrow(run, "class long, n int, i int, g long"), "prefixes")


def _of_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes that a stored table of pairs (ca, cb) names."""
    ends = pairs.select(F.col("ca").alias("class")).unionByName(pairs.select(F.col("cb").alias("class"))).distinct()
    return _without(classes, stored(ends, "ends"), "class", "left_semi")


def _sketches(classes: DataFrame) -> DataFrame:
    """A stored table (class, bits): for each of SKETCH_BITS cells, whether it has an odd number of the set's shingles. Of two sets, at least as many shingles differ as bits do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PREFIX_ROWS):
                part = batch.slice(at, PREFIX_ROWS)
                n, g = part.column("n").to_numpy(), part.column("s").flatten().to_numpy()
                cell = np.repeat(np.arange(len(n)), n) * SKETCH_BITS + (g & (SKETCH_BITS - 1))
                odd = np.bincount(cell, minlength=len(n) * SKETCH_BITS).reshape(len(n), SKETCH_BITS) & 1
                bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(list(bits), pa.list_(pa.int64()))], names=["class", "bits"])

    return stored(classes.select("class", "n", "s").mapInArrow(run, "class long, bits array<long>"), "sketches")


def _near_classes(classes: DataFrame, above: float) -> DataFrame:
    """A stored table (ca, cb, similarity) of pairs of different sets (class, n, s) above the bound."""
    every = _prefixes(classes, above)
    # stored, as what a frequent shingle's rows are joined with: such a join may deal one key to several tasks
    shared = stored(every.groupBy("g").agg(F.count("*").alias("df")).where("df > 1").select("g"), "frequencies")
    # classes of such similarity are of sizes at most a step apart; a little wider, for the sake of rounding
    cell = F.floor(F.log("n") / F.lit(-math.log(above) * 1.0001)).cast("int")
    posted = stored(every.join(shared, "g").select("class", "n", "i", "g", cell.alias("cell")), "postings")
    a = posted.select("g", "cell", F.col("class").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    # of two cells side by side, the higher one's classes come to the lower one
    b = posted.select("g", F.col("cell").alias("own"), F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("cell"), F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    na, nb = F.col("na"), F.col("nb")
    sized = F.least(na, nb) > F.lit(above) * F.greatest(na, nb)
    # so many shingles such sets of these sizes share; before the first of them stand no more than the rest
    least = F.ceil(F.lit(above / (1 + above)) * (na + nb) - 1e-9)
    first = (F.col("ia") <= na - least) & (F.col("ib") <= nb - least)
    once = (F.col("own") > F.col("cell")) | (F.col("ca") < F.col("cb"))
    pairs = stored(a.join(b, ["g", "cell"]).where(once & sized & first).select("ca", "cb", "na", "nb").distinct(), "candidates")
    # pairs whose sketches differ in more bits than such sets can differ in shingles go before any set is moved
    sketches = _sketches(_of_pairs(classes, pairs))
    x, y = (sketches.select(F.col("class").alias(c), F.col("bits").alias(s)) for c, s in (("ca", "x"), ("cb", "y")))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    pairs = stored(pairs.join(x, "ca").join(y, "cb").where(apart <= na + nb - 2 * least).select("ca", "cb", "na", "nb"), "likely")
    met = _of_pairs(classes, pairs)
    both = pairs.join(met.select(F.col("class").alias("ca"), F.col("s").alias("x")), "ca").join(met.select(F.col("class").alias("cb"), F.col("s").alias("y")), "cb")
    inter = both.select("ca", "cb", "na", "nb", F.size(F.array_intersect("x", "y")).alias("shared"))
    similarity = F.col("shared") / (na + nb - F.col("shared"))
    return stored(inter.where(similarity > above).select("ca", "cb", similarity.alias("similarity")), "near")


def _similar(inter: DataFrame, above: float) -> DataFrame:
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return inter.where(similarity > above).select("a", "b", similarity.alias("similarity"))


def pattern_hits(leaves: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """leaves x patterns that match, with the first match: one pass over the leaves, all patterns in one expression."""
    found = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_extract(text, p, 0).alias("match")) for k, p in patterns.items()])
    hits = leaves.withColumn("__hit", F.explode(F.filter(found, lambda x: x["match"] != "")))
    return hits.select(*[c for c in leaves.columns if c != text], "__hit.pattern", "__hit.match")


def missing_parts(cards: DataFrame, key: str, parts: str, inventory: DataFrame, part: str) -> DataFrame:
    """Cards any of whose parts is not in the inventory, with the sorted list of those."""
    each = cards.select(key, F.explode(parts).alias(part)).distinct()
    return each.join(inventory.select(part), part, "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("missing"))
