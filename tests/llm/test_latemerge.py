"""Late overwrite of day files, against a plain version of the whole contract and on small batches."""

import datetime as dt
import hashlib
import math
import zlib
from collections import defaultdict
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cardamom.llm import latemerge, queries

DATA = "/root/testdata/sf0.001"
EPOCH = dt.datetime(1970, 1, 1)


def micros(x):
    return None if x is None else (x - EPOCH) // dt.timedelta(microseconds=1)


def day(x):
    return -1 if x is None else (x - EPOCH).days


def plain_rows(sales):
    rows = []
    for r in sales:
        rows.append(r)
        h = zlib.crc32(str(r["sale_id"]).encode())
        if h % 3 == 0 and day(r["sold_at"]) % 4 == 0:
            rows.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + dt.timedelta(days=h % 2), "arrived_at": r["arrived_at"] + dt.timedelta(days=1 + h % 97)})
    return rows


def plain_layout(rows):
    best = {}
    for r in rows:
        if r["sale_id"] not in best or r["arrived_at"] > best[r["sale_id"]]["arrived_at"]:
            best[r["sale_id"]] = r
    return best


def test_whole_contract(spark):
    table = pq.read_table(f"{DATA}/sales.parquet")
    sales = table.to_pylist()
    size = 1 + len(sales) // 1100
    rows = plain_rows(sales)
    cut = dt.datetime(2024, 3, 20)
    start, final = plain_layout(r for r in rows if r["arrived_at"] < cut), plain_layout(rows)
    dirty, days, want = set(), defaultdict(list), []
    for k, r in final.items():
        days[day(r["sold_at"])].append(r)
        if r["arrived_at"] >= cut:
            dirty |= {day(r["sold_at"])} | ({day(start[k]["sold_at"])} if k in start else set())
    for d, found in days.items():
        found.sort(key=lambda r: (-1 if r["sold_at"] is None else micros(r["sold_at"]), r["sale_id"]))
        for at in range(0, len(found), size):
            part = found[at : at + size]
            lines = [":".join("" if x is None else str(x) for x in (r["sale_id"], micros(r["sold_at"]), micros(r["arrived_at"]))) for r in part]
            cents = sum(0 if r["total"] is None else math.floor(100 * r["total"] + 0.5) for r in part)
            ids = hashlib.sha256(",".join(str(r["sale_id"]) for r in part).encode()).hexdigest()
            want.append((d, at // size, len(part), cents, sum(zlib.crc32(x.encode()) for x in lines), ",".join(table.column_names), ids, d in dirty))
    got = queries.op13_late_overwrite(spark, DATA).collect()
    names = ("day", "file_no", "n_rows", "cents", "rows_crc", "columns", "ids_sha256", "rewritten")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    # the files themselves, by another reader
    for r in got[::40]:
        file = pq.read_table(unquote(urlsplit(r["path"]).path), partitioning=None)
        assert file.column_names == table.column_names
        assert hashlib.sha256(",".join(map(str, file["sale_id"].to_pylist())).encode()).hexdigest() == r["ids_sha256"]


SCHEMA = "id string, n long, sold timestamp_ntz, came timestamp_ntz, day int, FILE_NO string"


def at(d, s=0):
    return None if d is None else EPOCH + dt.timedelta(days=d, seconds=s)


def row(id, n, sold, came):
    return (id, n, at(sold, n or 0), at(came), 7, "x")


def setup(spark, rows, size=2):
    df = spark.createDataFrame(rows, SCHEMA)
    layout = latemerge.Layout(latemerge.new_folder(spark, "test"), df.columns, "id", "came", "sold", size)
    return df, layout


def contents(layout):
    out = {}
    for f in sorted(Path(layout.path).rglob("*.parquet")):
        d, n = (int(f.parts[i].split("=")[1]) for i in (-3, -2))
        assert (d, n) not in out
        out[d, n] = [tuple(r.values()) for r in pq.read_table(f, partitioning=None).to_pylist()]
    return out


def expected(rows, size=2):
    best = {}
    for r in rows:
        if r[0] not in best or (r[3] or dt.datetime.min) > (best[r[0]][3] or dt.datetime.min):
            best[r[0]] = r
    days = defaultdict(list)
    for r in best.values():
        days[day(r[2])].append(r)
    out = {}
    for d, found in days.items():
        found.sort(key=lambda r: (r[2] or dt.datetime.min, r[0] is not None, r[0] or ""))
        out |= {(d, i // size): found[i : i + size] for i in range(0, len(found), size)}
    return out


def hashes(layout):
    return {str(f): f.read_bytes() for f in Path(layout.path).rglob("*.parquet")}


def test_batches_of_awkward_rows(spark):
    early = [row(None, 1, 3, 5), row("a", 1, 3, 5), row("a", 2, 4, 6), row("b", 3, 3, 5), row("c", 4, None, 5), row("", 5, -2, 5), row("d", 6, 9, None), row("e", 7, 20, 5), row("f", 8, 21, 5), row("a", 2, 4, 6)]
    df, layout = setup(spark, early)
    assert (layout.day, layout.file) == ("day_", "file_no_")
    latemerge.create(df, layout)
    assert contents(layout) == expected(early)
    before = hashes(layout)
    # a moves to another day, e leaves its day empty, b's late row is older than what stands, g is new, the null key is replaced
    late = [row("a", 12, 3, 8), row("e", 17, 9, 8), row("b", 13, 3, 4), row("g", 18, 30, 8), row("d", 16, None, 8), row(None, 11, 3, 9), row("g", 19, 30, 9), row("b", 1, 21, None)]
    dirty = latemerge.overwrite(spark.createDataFrame(late, SCHEMA), layout)
    assert sorted(r["day"] for r in dirty.collect()) == [-1, 3, 4, 9, 20, 30]
    assert contents(layout) == expected(early + late)
    after = hashes(layout)
    untouched = {f for f in before if f"{layout.day}=21/" in f or f"{layout.day}=-2/" in f}
    assert untouched and all(after[f] == before[f] for f in untouched)
    assert not set(after) & (set(before) - untouched)
    assert not any("_staged" in str(p) for p in Path(layout.path).iterdir())


def test_batches_that_change_nothing(spark):
    df, layout = setup(spark, [row("a", 1, 3, 5), row("b", 1, 4, 5)])
    latemerge.create(df, layout)
    before = hashes(layout)
    assert latemerge.overwrite(df.limit(0), layout).count() == 0
    assert latemerge.overwrite(df.withColumn("came", F.lit(None).cast("timestamp_ntz")), layout).count() == 0
    assert latemerge.overwrite(df, layout).count() == 0
    assert hashes(layout) == before


def test_into_nothing(spark):
    df, layout = setup(spark, [row("a", 1, 3, 5), row("b", 1, 4, 5), row("a", 2, 3, 6)])
    assert sorted(r["day"] for r in latemerge.overwrite(df, layout).collect()) == [3, 4]
    assert contents(layout) == {(3, 0): [row("a", 2, 3, 6)], (4, 0): [row("b", 1, 4, 5)]}


def test_one_day_and_one_key_have_most_rows(spark):
    rows = [row("hot", i % 50, 5, i % 70) for i in range(600)] + [row(f"k{i}", i % 13, 5, 3) for i in range(500)]
    df, layout = setup(spark, [], 7)
    latemerge.create(spark.createDataFrame(rows, SCHEMA).repartition(6), layout)
    got = contents(layout)
    assert sorted(n for _, n in got) == list(range(math.ceil(501 / 7))) and {len(x) for k, x in got.items() if k[1] < 71} == {7}
    assert sorted(r[0] for x in got.values() for r in x) == sorted(["hot", *(f"k{i}" for i in range(500))])
    # ties of arrival in the hot key go to the greater row
    assert got == expected([r for r in rows if r[0] != "hot"] + [max((r for r in rows if r[0] == "hot"), key=lambda r: (r[3], r[1]))], 7)


def test_zone_of_the_session_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(at(19792, 86399),)], "t timestamp_ntz").select("t", F.timestamp_micros(F.lit(19792 * 86_400_000_000 - 1)).alias("z"), F.lit(None).cast("timestamp_ntz").alias("no"))
        assert tuple(df.select(*[latemerge.utc_day(df, c) for c in df.columns], latemerge.utc_micros(df, "t")).first()) == (19792, 19791, -1, (19792 * 86400 + 86399) * 10**6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_files_need_rows():
    with pytest.raises(ValueError):
        latemerge.Layout("x", ["a"], "a", "a", "a", 0)
