"""Tables that rows are only added to, with an index of which file may hold which key.

Beside a table at <path> lies <path>.index: for each file the number of its rows, the least and the greatest
key, and a Bloom filter of its keys. A batch is held against the index first, and only files that may hold one of its keys
are opened to see which it has already. Files that the index lacks (of an append that stopped before it was
indexed, or of other writers) are indexed by the next append.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship, stored
from .files import exists

#: Bits of a filter for each key, and how many of them a key sets: about one key in a hundred is taken for a known one.
BITS_A_KEY, PROBES = 10, 7
#: Bytes of filters that are sent to the tasks at once.
ROUND_BYTES = 64 << 20


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES rows of the bits that 64-bit hashes have in a filter."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(PROBES)])


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each file of rows (file, n, hash) that come file by file. One filter is held at a time."""
    at, bits, size = None, None, 0

    def done() -> Iterator[pa.RecordBatch]:
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["file", "bits"])

    for b in batches:
        files, n, hashes = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        i = 0
        while i < len(files):
            j = i
            while j < len(files) and files[j] == files[i]:
                j += 1
            if files[i] != at:
                yield from done()
                at, size = files[i], 8 * -(-max(n[i], 1) * BITS_A_KEY // 8)
                bits = np.zeros(size, bool)
            bits[_places(hashes[i:j], size).ravel()] = True
            i = j
    yield from done()


def _may_hold(batches: Iterator[pa.RecordBatch], filters: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Names of the files whose filter knows one of the hashes, once for each task."""
    left = [(f, np.frombuffer(bits, np.uint8)) for f, bits in filters]
    for b in batches:
        hashes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = []
        for name, bits in left:
            at = _places(hashes, 8 * len(bits))
            ok = np.ones(len(hashes), bool)
            for row in at:
                row = row.astype(np.int64)
                ok &= (bits[row >> 3] >> (7 - (row & 7)).astype(np.uint8) & 1).astype(bool)
            if ok.any():
                found.append(name)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["file"])
        left = [x for x in left if x[0] not in set(found)]


@dataclass(frozen=True)
class Appended:
    """What an append did: rows that were new, files that were opened to find out, files there were."""

    rows: int
    opened: int
    files: int


class KeyedTable:
    """A table of flat files at a path, each of `rows_per_file` rows at most, to which rows with new keys are added.

    Keys are of one atomic type. Rows of null key can't be known: each batch adds one of them. Of
    equal keys in a batch one row is added.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, format: str = "parquet", rows_per_file: int = 1_000_000) -> None:
        self.spark, self.path, self.key, self.format, self._most = spark, path.rstrip("/"), key, format, rows_per_file
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _load(self, names: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.schema(self.schema).format(self.format)
        return reader.load(self.path) if names is None else reader.load([f"{self.path}/{n}" for n in names])

    def read(self) -> DataFrame:
        return self._load() if exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def _files(self) -> list[str]:
        return sorted(f.rsplit("/", 1)[1] for f in self._load().inputFiles()) if exists(self.spark, self.path) else []

    def _index(self) -> DataFrame | None:
        at = f"{self.path}.index"
        return self.spark.read.parquet(at) if exists(self.spark, at) else None

    def refresh(self) -> int:
        """Indexes files that the index lacks; returns their number."""
        index = self._index()
        known = set() if index is None else {r["file"] for r in index.select("file").collect()}
        new = [f for f in self._files() if f not in known]
        if not new:
            return 0
        ship(self.spark)
        name = F.element_at(F.split("_metadata.file_path", "/"), -1)
        rows = self._load(new).select(name.alias("file"), F.col(self.key).alias("key"))
        sizes = stored(rows.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")), "sizes")
        hashed = rows.where("key is not null").join(sizes.select("file", "n"), "file").select("file", "n", F.xxhash64("key").alias("hash"))
        filters = hashed.repartition("file").sortWithinPartitions("file").mapInArrow(_filters, "file string, bits binary")
        sizes.join(filters, "file", "left").write.mode("append").parquet(f"{self.path}.index")
        return len(new)

    def candidates(self, batch: DataFrame) -> list[str]:
        """The files that may hold a key of the batch. Filters go to the tasks in rounds of ROUND_BYTES."""
        index = self._index()
        if index is None:
            return []
        keys = stored(batch.select(F.col(self.key).alias("key")).where("key is not null").select("key", F.xxhash64("key").alias("hash")), "keys")
        span = keys.agg(F.min("key").alias("least"), F.max("key").alias("most"))
        near = index.join(F.broadcast(span), (F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least"))).select("file", F.length("bits").alias("size"))
        rounds: list[list[str]] = [[]]
        held = 0
        for r in near.orderBy("file").collect():
            if held and held + r["size"] > ROUND_BYTES:
                rounds.append([])
                held = 0
            rounds[-1].append(r["file"])
            held += r["size"]
        found: set[str] = set()
        for names in filter(None, rounds):
            filters = self.spark.sparkContext.broadcast([(r["file"], bytes(r["bits"])) for r in index.where(F.col("file").isin(names)).select("file", "bits").collect()])
            met = keys.select("hash").mapInArrow(lambda b, f=filters: _may_hold(b, f.value), "file string").distinct()
            found |= {r["file"] for r in met.collect()}
            filters.destroy()
        return sorted(found)

    def append(self, batch: DataFrame) -> Appended:
        """Adds the batch's rows whose keys the table doesn't have."""
        self.refresh()
        batch = stored(batch.select(*[batch[f.name].cast(f.dataType).alias(f.name) for f in self.schema]).dropDuplicates([self.key]), "batch")
        names, files = self.candidates(batch), self._files()
        fresh = batch.join(self._load(names).select(self.key), self.key, "left_anti") if names else batch
        fresh = stored(fresh.select(*self.schema.names), "fresh")
        n = fresh.count()
        if n:
            fresh.write.mode("append").option("maxRecordsPerFile", self._most).format(self.format).save(self.path)
            self.refresh()
        return Appended(n, len(names), len(files))
