"""Plumbing shared by the operators: Arrow maps over a text column and tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship, spread, stored
from .wordhash import binary

__all__ = ["BROADCAST_BYTES", "PACK", "discard", "map_text", "parts", "returning", "small", "stored", "table"]

#: Bytes of text handed to an operator's kernel at once (one longer text goes alone).
PACK = 4 << 20
#: Bytes that a table sent to every task may have there at most.
BROADCAST_BYTES = 64 << 20
_TEXT = "__text"

#: Gets texts as UTF-8 bytes (None for null) and the further columns; returns one list or array for each output column.
Kernel = Callable[..., Sequence]


def parts(batch: pa.RecordBatch, columns: Sequence[int | str], limit: int = PACK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in these columns have `limit` bytes together, or one row of more.

    Slices share the batch's memory. How many bytes a batch has is Spark's setting
    (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), whatever the length of its texts.
    """
    if not batch.num_rows:
        return
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, at, before = np.cumsum(sizes), 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at, before = end, int(total[end - 1])


def _trim() -> None:
    """Gives memory that this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker keeps nothing of what its task had allocated.

    Spark keeps workers for later tasks. Without this, one that has held a vocabulary or a large batch keeps that memory beside the
    JVM's through all steps that follow.
    """

    @functools.wraps(run)
    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return returned


def map_text(df: DataFrame, outputs: str, factory: Callable[[], Kernel], text: str = "text", keep: Sequence[str] = ("doc_id",), also: Sequence[str] = ()) -> DataFrame:
    """Adds the columns of the DDL string `outputs`, computed from whole texts and the columns of `also`, to the kept columns.

    No shuffle; a lost task is done again from its input split alone. Only these columns are read. A kept column of an output's name gives way to the output. `factory` runs once in each task.
    """
    ship(df.sparkSession)
    made = StructType.fromDDL(outputs)
    names = set(made.names)
    keep = [c for c in keep if c not in names]
    # a kept text isn't sent twice
    own = keep.index(text) if text in keep and dict(df.dtypes)[text] == "string" else len(keep)
    more_at = len(keep) + (own == len(keep))
    source = spread(df.select(*[df[c] for c in keep], *([df[text].cast("string").alias(_TEXT)] if own == len(keep) else []), *[df[c].alias(f"__also{i}") for i, c in enumerate(also)]))
    schema = StructType([source.schema[c] for c in keep] + list(made.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kernel, into = factory(), to_arrow_schema(made)
        for batch in batches:
            for part in parts(batch, [own]):
                more = [part.column(more_at + i) for i in range(len(also))]
                new = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(kernel(binary(part.column(own)), *more), into, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=[*keep, *made.names])

    return source.mapInArrow(returning(run), schema)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that stored() made and that nothing reads any more."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(parent))
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int, width: Column | None = None, row_bytes: int = 32) -> bool:
    """Whether df has at most `most` rows and, at row_bytes and `width` bytes each, BROADCAST_BYTES at most in all.

    Found without reading more rows than that.
    """
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.lit(row_bytes) + (F.coalesce(width, F.lit(0)) if width is not None else F.lit(0)))).first()
    return n <= most and (size or 0) <= BROADCAST_BYTES
