"""Late rows merged into files cut by day: only the days that they touch are read and written again.

A layout keeps the latest row of each key, and cuts each day's rows, in one order, into files of a
fixed number of rows, one folder for each file: <path>/<day>=D/<file>=F/. A record index, dealt to buckets by a hash of
the key, holds for each key the day and the file that have its row, and when that row arrived. Late rows come down
to the latest of each key, which probe the index bucket by bucket: those that are later than the standing
row win, and are tagged with the place of the row that they replace. The days of winners and of rows that they replace
are dirty. Their files alone are read again, rows that lost their place are left out, winners are added, and the days
are cut anew beside the table. Then their folders take the places of the old ones; no other file is touched.

Rows travel by hashes of keys and by ranges of day and order, so that neither a key nor a day of any
share of the rows makes a large task. The driver handles names of days.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..session import shared_dir, shared_path, ship
from .common import discard, stored

#: Buckets of a record index.
BUCKETS = 32


def utc_micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken for UTC, whatever the session's zone."""
    if dict(df.dtypes)[c] == "timestamp":
        return F.unix_micros(c)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(F.col(c).cast("date")).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM `{c}`)") * 1_000_000).cast("long")


def utc_day(df: DataFrame, c: str) -> Column:
    """Whole days since 1970, -1 for null."""
    day = F.floor(utc_micros(df, c) / F.lit(86_400_000_000)) if dict(df.dtypes)[c] == "timestamp" else F.unix_date(F.col(c).cast("date"))
    return F.coalesce(day.cast("long"), F.lit(-1).cast("long"))


def _free(name: str, columns: Sequence[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


@dataclass
class Layout:
    """Where a table lies and how it is cut.

    Of equal keys the row with the greatest `by` stays, null being least; ties go to the greater row
    by its other columns. A null key is a key like any other. `day` is cut from the column `at`.
    """

    path: str
    columns: Sequence[str]
    key: str
    by: str
    at: str
    rows_per_file: int
    day: str = field(init=False)
    file: str = field(init=False)

    def __post_init__(self) -> None:
        # partition columns mustn't clash with the table's own
        self.day, self.file = _free("day", self.columns), _free("file_no", self.columns)
        if self.rows_per_file < 1:
            raise ValueError("a file has a row at least")


def _ident(key: Column) -> Column:
    """A key that is never null and never equal for unequal keys."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def latest(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row for each key. A key's rows are compared in each task first, whatever their number."""
    comparable = [f.name for f in rows.schema if isinstance(f.dataType, AtomicType)]
    order = F.struct(layout.by, *[c for c in comparable if c != layout.by])
    best = rows.groupBy(_ident(F.col(layout.key)).alias("__id")).agg(F.max_by(F.struct(*layout.columns), order).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in layout.columns])


def cut(rows: DataFrame, layout: Layout) -> DataFrame:
    """rows with their day and the number of their file in it.

    Dealt by ranges of day and order, which are numbered as they lie; a day that spans several ranges goes on counting.
    """
    order = [layout.day, layout.at, layout.key]
    dealt = rows.withColumn(layout.day, utc_day(rows, layout.at))
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("__range", F.shiftright("__at", 33)), "ranges")
    pieces = ranged.groupBy(layout.day, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(layout.day).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and each day
    starts = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.col("__before") + F.col("__at") - F.col("__first")
    placed = ranged.join(starts, [layout.day, "__range"])
    return placed.select(*layout.columns, layout.day, F.floor(place / F.lit(layout.rows_per_file)).cast("long").alias(layout.file))


def _write(rows: DataFrame, layout: Layout, path: str) -> None:
    """A file for each day and number. One task writes it as it reads its rows, in order."""
    parts = [layout.day, layout.file]
    rows.repartition(*parts).sortWithinPartitions(*parts, layout.at, layout.key).write.partitionBy(*parts).parquet(path)


def create(rows: DataFrame, layout: Layout) -> None:
    """Writes the layout of rows at its path, which must be new."""
    _write(cut(latest(rows, layout), layout), layout, layout.path)


def _read(spark: SparkSession, layout: Layout, schema, days: Sequence[int] | None = None) -> DataFrame | None:
    """The table, or some days of it; None if it has no files there."""
    at = [layout.path] if days is None else [f"{layout.path}/{layout.day}={d}" for d in days]
    found = [p for p in at if _exists(spark, p)]
    if not found:
        return None
    whole = schema.add(layout.day, "long").add(layout.file, "long")
    return spark.read.schema(whole).option("basePath", layout.path).parquet(*found)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


class RecordIndex:
    """Day, file and arrival of each key's row, as a table of buckets by a hash of the key. Probes meet it without moving it."""

    def __init__(self, table: DataFrame, layout: Layout) -> None:
        spark = table.sparkSession
        self.name, self.spark, self.path = f"record_index_{uuid.uuid4().hex}", spark, shared_path(spark, "index")
        rows = table.select(_ident(F.col(layout.key)).alias("__id"), F.col(layout.day).alias("__day"), F.col(layout.file).alias("__file"), F.col(layout.by).alias("__by"))
        rows.repartition(BUCKETS, "__id").write.bucketBy(BUCKETS, "__id").sortBy("__id").option("path", self.path).saveAsTable(self.name)

    def probe(self, rows: DataFrame, layout: Layout) -> DataFrame:
        """Those rows, one for each key, that have no row in the table or are later than it: with __id, and with __day and __file of the row that they replace (null if none)."""
        asked = rows.withColumn("__id", _ident(F.col(layout.key)))
        met = asked.join(self.spark.table(self.name).withColumn("__stands", F.lit(True)), "__id", "left")
        later = F.col("__stands").isNull() | F.coalesce(F.col(layout.by) > F.col("__by"), F.col(layout.by).isNotNull())
        return met.where(later).drop("__by", "__stands")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def overwrite(late: DataFrame, layout: Layout) -> DataFrame:
    """Makes the table at layout.path that of its rows and late ones; returns the dirty days (day long), a stored table.

    A late row that isn't later than the standing row of its key changes nothing. An empty batch, or one without
    winners, writes nothing. A run that stops before the folders change places leaves the old table
    as it was, with a folder `_staged` that no reader sees.
    """
    spark = late.sparkSession
    schema = late.select(*layout.columns).schema
    standing = _read(spark, layout, schema)
    best = latest(late.select(*layout.columns), layout)
    if standing is None:
        won = stored(best.withColumn("__id", _ident(F.col(layout.key))).withColumn("__day", F.lit(None).cast("long")).withColumn("__file", F.lit(None).cast("long")), "winners")
    else:
        index = RecordIndex(standing, layout)
        won = stored(index.probe(best, layout), "winners")
        index.drop()
    days = won.select(F.explode(F.array_compact(F.array(utc_day(won, layout.at), "__day"))).alias("day")).distinct()
    dirty = stored(days, "dirty")
    names = sorted(r["day"] for r in dirty.collect())
    if not names:
        return dirty
    merged = won.select(*layout.columns)
    old = _read(spark, layout, late.select(*layout.columns).schema, names)
    if old is not None:
        # a replaced row is known by the day and file of its tag, and its key in there
        gone = won.where("__day is not null").select("__id", F.col("__day").alias("__d"), F.col("__file").alias("__f"))
        same = (F.col("__d") == F.col(layout.day)) & (F.col("__f") == F.col(layout.file)) & (gone["__id"] == _ident(F.col(layout.key)))
        merged = old.join(gone, same, "left_anti").select(*layout.columns).unionByName(merged)
    staged = f"{layout.path}/_staged"
    _write(cut(merged, layout), layout, staged)
    for day in names:
        fs, old_day = _fs(spark, f"{layout.path}/{layout.day}={day}")
        new_day = _fs(spark, f"{staged}/{layout.day}={day}")[1]
        if fs.exists(old_day):
            fs.delete(old_day, True)
        if fs.exists(new_day) and not fs.rename(new_day, old_day):
            raise OSError(f"can't put day {day} in its place")
    fs, where = _fs(spark, staged)
    fs.delete(where, True)
    discard(spark, won)
    return dirty


def files(spark: SparkSession, layout: Layout) -> DataFrame:
    """(path, row_index, the table's columns, day, file) of every row of every file, as the files have it."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(layout.path)
    name = F.col("_metadata.file_path")

    def part(of: str) -> Column:
        return F.regexp_extract(name, rf"/{of}=(-?[0-9]+)/", 1).cast("long").alias(f"__{of}")

    return rows.select(name.alias("__path"), F.col("_metadata.row_index").alias("__row"), part(layout.day), part(layout.file), *rows.columns)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file of rows that come file by file, in order: sums and the digest of its ids, one batch of it at a time."""
    at, made = None, []

    def done() -> None:
        if at is not None:
            made.append((*at[:3], at[3], at[4], at[5], at[6].hexdigest()))

    for b in batches:
        paths = b.column(0).to_pylist()
        days, numbers, ids, cents, crcs = (b.column(i).to_pylist() for i in range(1, 6))
        i, n = 0, len(paths)
        while i < n:
            j = i
            while j < n and paths[j] == paths[i]:
                j += 1
            text = ",".join(ids[i:j])
            if at is None or at[0] != paths[i]:
                done()
                at = [paths[i], days[i], numbers[i], 0, 0, 0, hashlib.sha256()]
            else:
                text = "," + text
            at[3] += j - i
            at[4] += sum(cents[i:j])
            at[5] += sum(crcs[i:j])
            at[6].update(text.encode("utf-8"))
            i = j
    done()
    names = ["path", "day", "file_no", "n_rows", "cents", "rows_crc", "ids_sha256"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)


def digest(rows: DataFrame, id: Column, cents: Column, crc: Column) -> DataFrame:
    """(path, day, file_no, n_rows, cents, rows_crc, ids_sha256) of each file that files() lists. A null id is empty in the digest, null cents are none."""
    ship(rows.sparkSession)
    day, number = rows.columns[2:4]
    zero = F.lit(0).cast("long")
    light = rows.select("__path", day, number, F.coalesce(id.cast("string"), F.lit("")).alias("id"), F.coalesce(cents, zero).alias("cents"), F.coalesce(crc, zero).alias("crc"), "__row")
    ordered = light.repartition("__path").sortWithinPartitions("__path", "__row")
    return ordered.mapInArrow(_digests, "path string, day long, file_no long, n_rows long, cents long, rows_crc long, ids_sha256 string")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which stays when the application ends."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
