"""Pages and files fetched at each host's pace, and kept as they come.

Requests are planned once: those of a host start its delay apart, and rounds of some minutes take what starts in them.
A job takes one round, or several where those before it ended long before their time (_together). In a job a host
belongs to one task, which calls it once at a time, so what a task has of a host is bounded by the job's rounds and not
by the host. Each task's results are added to a table of pages when it ends; a run that stopped goes on with what has no
result yet.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship, stored
from .crawl import schedule

PAGES = "cache_key string, url string, host string, run string, round int, began double, status int, content_type string, length long, oversize boolean, body binary, error string, attempts int, fetched_at timestamp"
#: Bytes of a body beyond which it isn't kept, and of kept bodies that a task holds before it passes them on.
MOST_BYTES, BATCH_BYTES = 5 << 20, 16 << 20
#: A job takes one round of so many that are over, at most, so that a stopped run repeats a small share of what it has of a host.
SHARE = 8

#: Gets a URL; returns status, content_type, length (null if not told) and chunks, an iterable of bytes. An exception is a failed call.
Client = Callable[[str], dict]


class Clock:
    """The time of tasks, in seconds since 1970; tests bring their own."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


def _body(chunks: Iterable[bytes], length: int | None, most: int) -> tuple[bytes | None, int]:
    """The body and its length as far as known. Nothing is read of what is told to be too long, and no chunk after the one that makes it so."""
    try:
        if length is not None and length > most:
            return None, length
        kept, size = [], 0
        for chunk in chunks:
            size += len(chunk)
            if size > most:
                return None, size
            kept.append(chunk)
        return b"".join(kept), size
    finally:
        getattr(chunks, "close", lambda: None)()


def _together(over: int, rounds: int, took: float, round_seconds: float) -> int:
    """How many rounds the next job takes, when so many are over, of which the last job took `rounds` in `took` seconds.

    As many as would take the time of one round, at the last job's speed. Where calls wait for their time, that is one; with a
    clock that skips the wait, or where nothing fell due, a job has its own costs alone, which many rounds then share.
    """
    return max(1, min(over // SHARE, math.floor(rounds * round_seconds / took)))


def _paced(factory: Callable[[], Client], clock: Callable[[], Clock], run: str, first: int, round_seconds: float, most: int, retries: int, wait: Callable[[int, Exception], float | None]):
    """The calls of a job, of rounds from `first` on: rows of (cache_key, url, host, round, start, pace), as they fall due, become rows of PAGES."""
    schema = StructType.fromDDL(PAGES)

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        into = to_arrow_schema(schema)
        client, watch = factory(), clock()
        begin, ended, rows, held = watch.now(), {}, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                pace = r["pace"]
                # a pace after the job's begin, as another task may have called the host just before
                due = max(begin + r["start"] - first * round_seconds, ended.get(r["host"], -math.inf)) + pace
                attempt = 0
                while True:
                    if (left := due - watch.now()) > 0:
                        watch.sleep(left)
                    got, error, body, size, began = {}, None, None, None, watch.now()
                    try:
                        got = client(r["url"])
                        body, size = _body(got.get("chunks") or (), got.get("length"), most)
                    except Exception as failed:  # noqa: BLE001  any failure of the client is the row's
                        got, error = {}, f"{type(failed).__name__}: {failed}"
                        pause = wait(attempt, failed) if attempt < retries else None
                    ended[r["host"]] = watch.now()
                    if error is None or pause is None:
                        break
                    due, attempt = ended[r["host"]] + max(pause, pace), attempt + 1
                rows.append(
                    {
                        "cache_key": r["cache_key"], "url": r["url"], "host": r["host"], "run": run, "round": r["round"], "began": began - begin - (r["round"] - first) * round_seconds, "status": got.get("status"), "content_type": got.get("content_type"),
                        "length": size, "oversize": None if error else body is None, "body": body, "error": error, "attempts": attempt + 1, "fetched_at": datetime.fromtimestamp(ended[r["host"]], UTC),
                    }
                )
                held += len(body or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, into)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, into)
                rows, held = [], 0

    return calls


def kept_pages(spark: SparkSession, path: str) -> DataFrame:
    """The table of pages at a path; empty if there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], PAGES)
    return spark.read.schema(PAGES).parquet(path)


def cache_key(by: Sequence[str] = ()) -> Column:
    """The key of a request in the table of pages: its URL's, or, with `by`, that of its URL and these columns."""
    return F.sha1((F.to_json(F.struct("url", *by)) if by else F.col("url")).cast("binary"))


def fetch_pages(
    requests: DataFrame, path: str, factory: Callable[[], Client], run: str, order: str = "url", delays: DataFrame | None = None, seconds: float = 2.0, round_seconds: float = 600.0,
    days: int = 7, most_bytes: int = MOST_BYTES, retries: int = 0, wait: Callable[[int, Exception], float | None] = lambda attempt, error: 0.0, clock: Callable[[], Clock] = Clock, tasks: int | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Calls the URLs of requests (url, host, an order) that have no page yet, adds the results to the table at path, and returns that.

    A page is there if this `run` has any result of it, or if any run has got it with status 200 in the last `days` days. Calls
    of a host are one after the other, in their order, its delay after the end of the one before (`delays`: host, delay;
    `seconds` at least). A failure is tried again as `wait` says, `retries` times at most, at the host's pace too. A body
    of more than `most_bytes` is oversize, and no more of it is read. `began` counts from a round's begin, which is `round_seconds`
    after that of the round before it in their job. Equal URLs are called once, or, with `by`, once for
    each of these columns' values, which cache_key() tells apart; rows without a URL or a host aren't called. A stopped run, begun again under its name, calls no page again but those of the tasks that
    were at work when it stopped, as do tasks of lost executors. Speculative tasks would call a host twice at a time, so
    they are an error.
    """
    spark = requests.sparkSession
    if seconds <= 0 or round_seconds <= 0:
        raise ValueError("seconds and round_seconds must be above 0")
    if (spark.sparkContext.getConf().get("spark.speculation") or "false").lower() == "true":
        raise ValueError("spark.speculation must be off: two tasks would call a host at once")
    ship(spark)
    known, since = kept_pages(spark, path), F.timestamp_seconds(F.lit(clock().now() - days * 86400.0))
    done = known.where((F.col("run") == run) | (F.col("error").isNull() & (F.col("status") == 200) & (F.col("fetched_at") >= since))).select("cache_key").distinct()
    once = requests.where("url is not null and host is not null").groupBy(cache_key(by).alias("cache_key"), "url").agg(F.min(F.struct(F.col(order).alias("at"), "host")).alias("r"))
    todo = once.select("cache_key", "url", "r.host", "r.at").join(done, "cache_key", "left_anti")
    planned = schedule(todo, "host", "at", delays, seconds)
    pace = F.greatest(F.col("delay"), F.lit(seconds)) if delays is not None else F.lit(seconds)
    calls = planned.select("cache_key", "url", "host", F.floor(F.col("start") / round_seconds).cast("int").alias("round"), F.col("start").cast("double").alias("start"), pace.cast("double").alias("pace"))
    # by time, so that a job reads the files that have its rounds
    plan = stored(calls.repartitionByRange("round", "cache_key").sortWithinPartitions("round"), "plan")
    last = plan.agg(F.max("round")).first()[0]
    # the rounds' number follows from the longest host's calls, that of jobs from its logarithm where nothing has to wait
    over, rounds = 0, 1
    while last is not None and over <= last:
        due = plan.where(F.col("round").between(over, over + rounds - 1))
        owned = due.repartition(tasks or spark.sparkContext.defaultParallelism, "host").sortWithinPartitions(F.col("start") + F.col("pace"), "host")
        got = owned.mapInArrow(_paced(factory, clock, run, over, round_seconds, most_bytes, retries, wait), PAGES)
        began = time.monotonic()
        # results of a task count when the task ends, whatever becomes of the others
        got.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        over += rounds
        rounds = _together(over, rounds, time.monotonic() - began, round_seconds)
    return kept_pages(spark, path)
