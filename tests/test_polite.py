"""Polite fetching: the pace of each host, stopped runs, bodies that are too long, failures."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cardamom.session import shared_path
from cardamom.sources import polite

REQUESTS = "url string, host string"


def requests(spark, sizes):
    return spark.createDataFrame([(f"https://{h}/{i:03d}", h) for h, n in sizes.items() for i in range(n)], REQUESTS)


def _skipping():
    # a class that workers get by value, as they don't have this module
    class Skipping(polite.Clock):
        def __init__(self):
            self.at = time.time()

        def now(self):
            return self.at

        def sleep(self, seconds):
            self.at += seconds

    return Skipping


Skipping = _skipping()


def logging_client(log, bad=lambda url: False):
    """A client that leaves a line of each call in a folder, and stops its task at bad URLs as a lost worker would."""

    def factory():
        import os
        import uuid

        def client(url):
            if bad(url):
                os._exit(1)
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{url} {time.time()}")
            return {"status": 200, "chunks": [url.encode()]}

        return client

    return factory


def calls(log):
    return sorted(tuple(f.read_text().split()) for f in log.iterdir())


def test_hosts_keep_their_pace(spark, tmp_path):
    got = polite.fetch_pages(requests(spark, {"a": 5, "b": 3, "c": 1}), shared_path(spark, "crawl"), logging_client(tmp_path), "r", delays=spark.createDataFrame([("b", 0.5)], "host string, delay double"), seconds=0.2, round_seconds=0.5)
    assert got.count() == 9 and got.agg(F.max("round")).first()[0] == 2
    at = defaultdict(list)
    for url, t in calls(tmp_path):
        at[url.split("/")[2]].append(float(t))
    # rounds are different tasks, and keep apart as well
    for host, pace in (("a", 0.2), ("b", 0.5)):
        assert all(y - x >= pace - 0.01 for x, y in zip(sorted(at[host]), sorted(at[host])[1:], strict=False))


def test_a_stopped_run_goes_on(spark, tmp_path):
    sizes, path = {f"h{i}": 6 for i in range(8)}, shared_path(spark, "crawl")
    with pytest.raises(Exception, match="(?i)python worker"):  # the job fails as a whole
        polite.fetch_pages(requests(spark, sizes), path, logging_client(tmp_path, lambda url: url == "https://h3/004"), "r", round_seconds=4.0, clock=Skipping, tasks=8)
    kept = polite.kept_pages(spark, path)
    before = {r["url"] for r in kept.collect()}
    # two rounds of two calls to a host were done and kept, and what tasks ended in the third
    assert len(before) >= 32 and "https://h3/003" in before and "https://h3/004" not in before
    for f in tmp_path.iterdir():
        f.unlink()
    got = polite.fetch_pages(requests(spark, sizes), path, logging_client(tmp_path), "r", clock=Skipping)
    assert sorted(r["url"] for r in got.collect()) == sorted(r["url"] for r in requests(spark, sizes).collect())
    assert {u for u, _ in calls(tmp_path)} == {f"https://{h}/{i:03d}" for h in sizes for i in range(6)} - before
    assert polite.fetch_pages(requests(spark, sizes), path, logging_client(tmp_path), "other", clock=Skipping).count() == 48


def test_long_bodies_are_not_read(spark):
    read = []

    def chunks(n):
        for i in range(n):
            read.append(i)
            yield b"x" * 10

    assert polite._body(chunks(3), None, 30) == (b"x" * 30, 30)
    assert polite._body(chunks(100), None, 30) == (None, 40) and len(read) == 3 + 4
    assert polite._body(chunks(100), 1000, 30) == (None, 1000) and len(read) == 7
    assert polite._body(chunks(100), 10, 30) == (None, 40)  # a length that isn't true


def test_failures_and_awkward_rows(spark):
    def factory():
        tries = defaultdict(int)

        def client(url):
            tries[url] += 1
            if url.endswith("2") or url.endswith("1") and tries[url] < 3:
                raise ConnectionError("503")
            return {"status": 404 if url.endswith("3") else 200, "chunks": [b"ok"]}

        return client

    path = shared_path(spark, "crawl")
    some = requests(spark, {"a": 5}).unionByName(spark.createDataFrame([(None, "a"), ("x", None), ("https://a/000", "a")], REQUESTS))
    wait = lambda attempt, error: 3.0 if attempt < 2 else None
    rows = {r["url"][-1]: r for r in polite.fetch_pages(some, path, factory, "r", retries=9, wait=wait, clock=Skipping).collect()}
    assert {k: (r["status"], r["attempts"], r["error"]) for k, r in rows.items()} == {"0": (200, 1, None), "1": (200, 3, None), "2": (None, 3, "ConnectionError: 503"), "3": (404, 1, None), "4": (200, 1, None)}
    # retries after 3 seconds each; the next page waits for its pace after them
    assert [round(rows[k]["began"], 3) for k in "01234"] == [2, 10, 18, 20, 22]
    # another run gets what failed or is gone once more, and nothing else
    again = polite.fetch_pages(some, path, factory, "s", clock=Skipping).where("run = 's'")
    assert sorted(r["url"][-1] for r in again.collect()) == ["2", "3"]
    assert polite.fetch_pages(some.limit(0), shared_path(spark, "none"), factory, "r").count() == 0
    with pytest.raises(ValueError):
        polite.fetch_pages(some, path, factory, "r", seconds=0)


def test_many_rounds_take_few_jobs(spark):
    """A host of 100 rounds, where no call has to wait; each row has the round and the second of its plan."""

    def factory():
        return lambda url: {"status": 200, "chunks": [b"ok"]}

    delays, pace = spark.createDataFrame([("b", 7.5)], "host string, delay double"), {"a": 2.0, "b": 7.5}
    some = spark.createDataFrame([(f"https://{h}/{i:04d}", h) for h, n in (("a", 3000), ("b", 300)) for i in range(n)], REQUESTS)
    got = polite.fetch_pages(some, shared_path(spark, "crawl"), factory, "r", delays=delays, round_seconds=60.0, clock=Skipping, tasks=2)
    file = F.input_file_name()
    rows = got.select("url", "host", "round", "began", file.alias("file"), F.regexp_extract(file, r"part-\d+-([0-9a-f-]{36})", 1).alias("job")).collect()
    assert len(rows) == 3300 and max(r["round"] for r in rows) == 99
    for r in rows:
        start = int(r["url"].split("/")[-1]) * pace[r["host"]]
        assert (r["round"], round(r["began"], 3)) == (start // 60, start % 60 + pace[r["host"]])
    assert len({r["job"] for r in rows}) <= 45
    # a host belongs to one task of a job
    assert len({(r["job"], r["host"], r["file"]) for r in rows}) == len({(r["job"], r["host"]) for r in rows})


def test_rounds_of_a_job():
    assert [polite._together(over, 1, 0.1, 60.0) for over in (1, 8, 15, 16, 800)] == [1, 1, 1, 2, 100]
    # calls that wait make a job as long as its rounds are, and keep it to one of them
    assert polite._together(800, 1, 60.1, 60.0) == polite._together(800, 5, 300.5, 60.0) == 1
    assert polite._together(800, 10, 100.0, 60.0) == 6


def test_a_stop_in_a_job_of_several_rounds(spark, tmp_path):
    path, some = shared_path(spark, "crawl"), requests(spark, {"a": 80})
    with pytest.raises(Exception, match="(?i)python worker"):
        polite.fetch_pages(some, path, logging_client(tmp_path, lambda url: url == "https://a/070"), "r", round_seconds=4.0, clock=Skipping, tasks=1)
    before = {r["url"] for r in polite.kept_pages(spark, path).collect()}
    # the 36th round was in a job of four at most
    assert len(before) >= 64 and before == {f"https://a/{i:03d}" for i in range(len(before))}
    for f in tmp_path.iterdir():
        f.unlink()
    got = polite.fetch_pages(some, path, logging_client(tmp_path), "r", clock=Skipping)
    assert sorted(r["url"] for r in got.collect()) == [f"https://a/{i:03d}" for i in range(80)]
    assert [u for u, _ in calls(tmp_path)] == [f"https://a/{i:03d}" for i in range(len(before), 80)]
