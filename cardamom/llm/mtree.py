"""Exact top-k search by inner product: M-trees over shards, searched best first.

An inner product becomes a metric by one more coordinate. With every vector x of a shard
lengthened to the same norm M, x' = (x, sqrt(M^2 - |x|^2)), and q' = (q, 0), the squared
Euclidean distance is |q|^2 + M^2 - 2 <q, x>: the nearest vectors have the highest scores.

A query begins at the leaf whose routing vector is nearest, which gives its k-th score a lower
bound; a bound from other shards may be known already. Pages, their entries and their vectors
out of its reach are then left out without computing their distances. Which tree a vector is in
goes by the nearest of some means, and a tree's vectors reach so far from their mean at most:
a query enters the nearest cells first, and then those that its k-th score can't rule out. How
much is left out depends on the vectors: in clusters most, in directions drawn at random none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, stored

#: Vectors of a leaf page, entries of an inner page.
PAGE, FANOUT = 64, 16
#: Vectors in one tree; queries that meet it in one task, at most, and at least where a round has fewer shards than the cluster has cores; queries
#: searched together. The first and the last bound a task's memory, the others its time.
SHARD_ROWS, TASK_QUERIES, FEW_QUERIES, BLOCK = 20_000, 1_000_000, 20_000, 1024
#: Leaves at which a query begins; cells that a query enters before its k-th score rules out others; tasks of a round at most.
BEGINNINGS, ENTERED, TASKS = 2, 2, 10_000
#: Cells at most, and how many vectors, of how many numbers together, their means are found from: a sample on the driver, which decides
#: the tree that a vector is in, and no result.
CELLS, SAMPLE_ROWS, SAMPLE_VALUES = 4096, 32_768, 1 << 22
#: Rows of a batch that goes to cells.
SENT = 4096


@dataclass
class Page:
    """A node: routing vector (lengthened), covering radius, distance to the parent's routing vector."""

    center: np.ndarray
    radius: float
    to_parent: float
    rows: np.ndarray | None = None  # of a leaf: its vectors' numbers,
    to_center: np.ndarray | None = None  # and their distances to the routing vector
    number: int = -1  # and the leaf's own
    children: list[Page] | None = None


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(1), 0))


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The number of each row's nearest mean; a block of rows at a time."""
    norms = (means**2).sum(1)
    return np.concatenate([np.empty(0, np.int64), *((norms - 2 * (x[at : at + BLOCK] @ means.T)).argmin(1) for at in range(0, len(x), BLOCK))])


def _moved(x: np.ndarray, k: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """k means after some turns of moving them, and the nearest of each row before the last."""
    means = x[np.random.default_rng(len(x)).choice(len(x), k, replace=False)]
    for _ in range(turns):
        owner = _nearest(x, means)
        size = np.bincount(owner, minlength=k)
        total = np.zeros((k, x.shape[1]))
        np.add.at(total, owner, x)
        means = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], means)
    return means, owner


def _parts(x: np.ndarray, k: int, turns: int = 5) -> np.ndarray:
    """The part, of k at most, that each row belongs to."""
    return _moved(x, k, turns)[1]


class MTree:
    """A paged metric tree over integer vectors, given as a float64 matrix, with their ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.vectors, self.ids = vectors, ids
        norms = (vectors**2).sum(1)
        self.norm2 = float(norms.max()) if len(norms) else 0.0
        self.long = np.concatenate([vectors, np.sqrt(np.maximum(self.norm2 - norms, 0))[:, None]], 1)
        self.leaves: list[Page] = []
        self.root = self._page(np.arange(len(ids)), None) if len(ids) else None
        self.centers = np.stack([p.center for p in self.leaves]) if self.leaves else np.empty((0, vectors.shape[1] + 1))
        self.computed = 0

    def _page(self, rows: np.ndarray, parent: np.ndarray | None) -> Page:
        x = self.long[rows]
        center = x[_distances(x, x.mean(0)).argmin()]
        d = _distances(x, center)
        page = Page(center, float(d.max()), 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum())))
        if len(rows) <= PAGE:
            order = d.argsort(kind="stable")
            page.rows, page.to_center, page.number = rows[order], d[order], len(self.leaves)
            self.leaves.append(page)
            return page
        owner = _parts(x, min(FANOUT, math.ceil(len(rows) / PAGE)))
        parts = [rows[owner == k] for k in np.unique(owner)]
        if max(map(len, parts)) > 0.9 * len(rows):  # repeated vectors, or one far outlier: halve by distance
            parts = np.array_split(rows[d.argsort(kind="stable")], 2)
        page.children = [self._page(p, center) for p in parts]
        return page

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of each query's k best, without the id in `own`; ties to smaller ids.

        Scores below a query's `floor` are left out. Pages come in the order of their smallest possible
        distance to a query of the block. A page, an entry of it or a vector is left out for the queries
        whose k-th score is out of its reach, by the covering radius and the stored distances, before its
        distance is computed.
        """
        n = len(queries)
        q2 = (queries**2).sum(1)
        best_q, best_i, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        kth = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)
        if self.root is None or not n:
            return best_q, best_i, best_s

        def within(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """Where a vector at distance `lower` or more could still be among the best (scores are whole numbers)."""
            lower = np.maximum(lower, 0)
            reach = (q2[rows] + self.norm2).reshape(-1, *[1] * (lower.ndim - 1)) - lower * lower
            return reach / 2 >= kth[rows].reshape(-1, *[1] * (lower.ndim - 1)) - 0.5

        def distance(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
            self.computed += len(rows) * (len(centers) if centers.ndim > 1 else 1)
            return np.sqrt(np.maximum((q2[rows] + self.norm2).reshape(-1, *[1] * (centers.ndim - 1)) - 2 * (queries[rows] @ centers[..., :-1].T), 0))

        def scan(rows: np.ndarray, members: np.ndarray) -> None:
            nonlocal best_q, best_i, best_s
            self.computed += len(rows) * len(members)
            scores = queries[rows] @ self.vectors[members].T
            i, j = np.nonzero((scores >= kth[rows][:, None]) & (self.ids[members] != own[rows][:, None]))
            if not len(i):
                return
            touched = np.zeros(n, bool)
            touched[rows[i]] = True
            old = touched[best_q]
            cq, ci, cs = (np.concatenate(x) for x in ((best_q[old], rows[i]), (best_i[old], self.ids[members][j]), (best_s[old], scores[i, j])))
            order = np.lexsort((ci, -cs, cq))
            cq, ci, cs = cq[order], ci[order], cs[order]
            place = np.arange(len(cq)) - np.searchsorted(cq, cq, "left")
            cq, ci, cs, place = (x[place < k] for x in (cq, ci, cs, place))
            full = place == k - 1
            kth[cq[full]] = np.maximum(kth[cq[full]], cs[full])
            best_q, best_i, best_s = (np.concatenate(x) for x in ((best_q[~old], cq), (best_i[~old], ci), (best_s[~old], cs)))

        everyone = np.arange(n)
        begun = np.empty((n, 0), np.int64)
        if len(self.leaves) > BEGINNINGS:
            begun = np.argpartition(distance(everyone, self.centers), BEGINNINGS - 1, 1)[:, :BEGINNINGS]
            for page in self.leaves:
                rows = np.flatnonzero((begun == page.number).any(1))
                if len(rows):
                    scan(rows, page.rows)
        heap = [(0.0, 0, self.root, everyone, distance(everyone, self.root.center))]
        serial = 1
        while heap:
            _, _, page, rows, d = heapq.heappop(heap)
            left = within(d - page.radius, rows)
            if page.children is None:
                left &= ~(begun[rows] == page.number).any(1)
            if not left.any():
                continue
            rows, d = rows[left], d[left]
            if page.children is None:
                some = within(np.abs(d[:, None] - page.to_center), rows)
                rows, members = rows[some.any(1)], page.rows[some.any(0)]
                if len(rows):
                    scan(rows, members)
                continue
            for child in page.children:
                may = within(np.abs(d - child.to_parent) - child.radius, rows)
                if may.any():
                    to = rows[may]
                    dc = distance(to, child.center)
                    heapq.heappush(heap, (float((dc - child.radius).min()), serial, child, to, dc))
                    serial += 1
        above = best_s >= kth[best_q] if floor is not None else np.ones(len(best_q), bool)
        return best_q[above], best_i[above], best_s[above]


def whole_vectors(df: DataFrame, vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch with one shard, part and kind of rows."""
    if not batch.num_rows:
        return
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "part", "q")], 1)
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _matrices(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the length, which rows have it, and those as a matrix."""
    lengths = rows.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length)
        yield length, same, rows.column("v").take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(same), length)


_FOUND = "query_id long, vec_id long, score long"


def _searched(k: int):
    """Streams rows sorted by shard and part, the vectors before the queries: those make a tree, past which these go in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, data, trees = None, {}, None
        for batch in batches:
            for (shard, part, is_query), rows in _stretches(batch):
                if place != (shard, part):
                    place, data, trees = (shard, part), {}, None
                ids = rows.column("id").to_numpy()
                if not is_query:
                    for length, same, x in _matrices(rows):
                        data.setdefault(length, []).append((x, ids[same]))
                    continue
                if trees is None:
                    trees = {length: MTree(np.concatenate([x for x, _ in own]), np.concatenate([i for _, i in own])) for length, own in data.items()}
                    data = {}
                floors = rows.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                floors[np.isnan(floors)] = -np.inf
                for length, same, queries in _matrices(rows):
                    if (tree := trees.get(length)) is None:
                        continue
                    for at in range(0, len(same), BLOCK):
                        block = same[at : at + BLOCK]
                        a, b, c = tree.search(queries[at : at + BLOCK], ids[block], k, floors[block])
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids[block][a], b, c)], names=["query_id", "vec_id", "score"])

    return run


class Cells:
    """Means of space for each length of vectors, numbered from 1. Vectors of a length without means are in cell 0.

    What the cells hold is set when it is known: `held` maps a cell to (vectors, the farthest one's
    distance to the mean, the largest square norm).
    """

    def __init__(self, samples: dict[int, np.ndarray], cells: int) -> None:
        total = sum(map(len, samples.values()))
        self.means: dict[int, tuple[int, np.ndarray]] = {}
        at = 1
        for length, x in sorted(samples.items()):
            x = np.unique(x, axis=0)
            k = min(len(x), max(1, cells * len(samples[length]) // max(1, total)))
            self.means[length] = at, _moved(x, k, 5)[0]
            at += k
        self.count, self.radius, self.norm2 = np.zeros(at, np.int64), np.zeros(at), np.zeros(at)

    def hold(self, held: dict[int, tuple[int, float, float]]) -> None:
        for cell, (count, radius, norm2) in held.items():
            self.count[cell], self.radius[cell], self.norm2[cell] = count, radius, norm2

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distance to the cell's mean."""
        if x.shape[1] not in self.means:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        first, means = self.means[x.shape[1]]
        owner = _nearest(x, means)
        return first + owner, _distances(x, means[owner])

    def visits(self, queries: np.ndarray, floor: np.ndarray, again: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query number, cell): each query's ENTERED cells of the nearest means, or, `again`, the others that may hold a score of its floor or more.

        With p the mean, r the radius and M the largest norm of a cell, a vector x of it has
        <q, x> <= <q, p> + |q| r, and 2 <q, x> <= |q|^2 + M^2 - max(0, |q - p| - r)^2.
        """
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        if queries.shape[1] not in self.means:
            return nothing if again or not self.count[0] else (np.arange(len(queries)), np.zeros(len(queries), np.int64))
        first, means = self.means[queries.shape[1]]
        own = slice(first, first + len(means))
        full = np.flatnonzero(self.count[own])
        if not len(full):
            return nothing
        means, radius, norm2 = means[full], self.radius[own][full], self.norm2[own][full]
        inner, q2 = queries @ means.T, (queries**2).sum(1)[:, None]
        away = np.sqrt(np.maximum(q2 + (means**2).sum(1) - 2 * inner, 0))
        near = np.argsort(away, 1, kind="stable")[:, :ENTERED]
        enters = np.zeros(inner.shape, bool)
        np.put_along_axis(enters, near, True, 1)
        if again:
            most = np.minimum(inner + np.sqrt(q2) * radius, (q2 + norm2 - np.maximum(away - radius, 0) ** 2) / 2)
            enters = ~enters & (most >= floor[:, None] - 0.5)  # scores are whole numbers
        rows, cells = np.nonzero(enters)
        return rows, first + full[cells]


def _dealt(cells: Cells):
    """Adds to rows of id, v and q the cell, the distance to its mean and the square norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away, norm2 = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for _, same, x in _matrices(batch):
                cell[same], away[same] = cells.place(x)
                norm2[same] = (x**2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away), pa.array(norm2)], names=[*batch.schema.names, "cell", "away", "norm2"])

    return run


def _sent(cells: Cells, shards: np.ndarray, groups: int, again: bool):
    """Sends rows of id, v and floor to a part of each shard of the cells that they visit. Cell c has the shards from shards[c] to before shards[c + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            floors[np.isnan(floors)] = -np.inf
            mixed = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)
            for _, same, x in _matrices(batch):
                for at in range(0, len(same), BLOCK):
                    block = same[at : at + BLOCK]
                    rows, cell = cells.visits(x[at : at + BLOCK], floors[block], again)
                    many = shards[cell + 1] - shards[cell]
                    rows = np.repeat(block[rows], many)
                    shard = np.repeat(shards[cell] - np.cumsum(many) + many, many) + np.arange(len(rows))
                    for i in range(0, len(rows), SENT):
                        own = rows[i : i + SENT]
                        made = [pa.array(shard[i : i + SENT].astype(np.int32)), pa.array(part[own]), pa.array(np.ones(len(own), bool))]
                        taken = batch.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([*made, *(taken.column(c) for c in ("id", "v", "floor"))], names=["shard", "part", "q", "id", "v", "floor"])

    return run


_SENT = "shard int, part int, q boolean, id long, v array<long>, floor double"


def _cells(clean: DataFrame, wanted: int, longest: int) -> Cells:
    """Cells of a bounded sample, the rows of the smallest hashes; none if one is enough."""
    wanted, samples = min(CELLS, wanted), {}
    rows = min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, longest))
    if wanted > 1 and rows > 1:
        sample = clean.select("v").orderBy(F.xxhash64("id", "v")).limit(min(rows, 64 * wanted)).toArrow()
        for batch in sample.to_batches():
            for length, _, x in _matrices(batch):
                samples.setdefault(length, []).append(x)
    return Cells({n: np.concatenate(x) for n, x in samples.items()}, wanted)


def top_k(vectors: DataFrame, query: Column, k: int = 20, id: str = "vec_id", vector: str = "v", shard_rows: int = SHARD_ROWS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all other rows.

    `vector` holds arrays of longs; inner products must stay below 2**53. Rows of null id or vector take
    no part, equal rows count once, and vectors meet only those of their length. Vectors are dealt to
    the cells of their nearest means, and a cell of more than `shard_rows`, as of a vector that many
    rows have, to several trees. A query searches the cells nearest to it, then, by the k-th score that
    it has by then, those that may hold a better one. A task holds one shard's tree, past which queries
    stream; tasks share a shard if its queries are more than `task_queries`, or if there are idle cores.
    """
    spark = vectors.sparkSession
    ship(spark)
    clean = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    clean = stored(clean.distinct(), "vectors")
    n, m, longest = clean.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    cells = _cells(clean, math.ceil(n / shard_rows), longest or 0)
    dealt = stored(clean.mapInArrow(_dealt(cells), "id long, v array<long>, q boolean, cell int, away double, norm2 double"), "dealt")
    held = {r["cell"]: (r["n"], r["away"], r["norm2"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("norm2").alias("norm2")).collect()}
    cells.hold(held)
    discard(spark, clean)
    shards = np.concatenate([[0], np.cumsum(-(-cells.count // shard_rows))])
    total, cores = max(1, int(shards[-1])), spark.sparkContext.defaultParallelism
    groups = max(1, math.ceil(m / task_queries), min(math.ceil(m / FEW_QUERIES), cores // total))
    # a row for each cell, CELLS and one at most
    begins = spark.createDataFrame([(c, int(shards[c]), int(shards[c + 1] - shards[c])) for c in range(len(cells.count))], "cell int, first int, many int")
    shard = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.greatest("many", F.lit(1)))).cast("int").alias("shard")
    data = dealt.join(F.broadcast(begins), "cell").select(shard, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(False).alias("q"), "id", "v", F.lit(None).cast("double").alias("floor"))
    asked, best = dealt.where("q").select("id", "v"), None
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rounds = (False, True) if any(len(means) > ENTERED for _, means in cells.means.values()) else (False,)
    for again in rounds:
        floors = asked.withColumn("floor", F.lit(None).cast("double"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
            floors = asked.join(kth, "id", "left")
        sent = floors.select("id", "v", "floor").mapInArrow(_sent(cells, shards, groups, again), _SENT)
        tasks = data.unionByName(sent).repartition(min(TASKS, total * groups), "shard", "part").sortWithinPartitions("shard", "part", "q")
        found = tasks.mapInArrow(_searched(k), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = stored(best, "best") if again != rounds[-1] else best
    return best.select("query_id", "rank", "vec_id", "score")
