"""Readers, writers, crawl tables and streams over files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from cardamom import schemas
from cardamom.sources import crawl, files, sinks
from cardamom.streaming import calls

CASE = "case_id string, kind string"


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# head\n https://a \n\nhttps://b\n")
    assert [r[0] for r in files.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a", "https://b"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"case_id": "a"}\n\n{broken\n{"case_id": "b"}\n')
    assert sorted(r[0] for r in files.read_jsonl(spark, str(path), CASE, "skip").collect()) == ["a", "b"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(path), CASE, "fail").collect()
    good, bad = files.split_json(spark.read.text(str(path)), CASE)
    assert good.count() == 2 and bad.first()["_raw"] == "{broken"
    assert files.read_known_keys(spark, str(path), "case_id", CASE).count() == 2
    assert files.read_known_keys(spark, str(tmp_path / "none"), "case_id", CASE).count() == 0


def test_directories_of_cases(spark, tmp_path):
    for part, ids in {"real-clean": "ab", "synthetic-dirty": "c"}.items():
        (tmp_path / part).mkdir()
        for i in ids:
            (tmp_path / part / f"{i}.json").write_text(json.dumps({"case_id": i, "kind": "text"}, indent=1))
        (tmp_path / part / "note.txt").write_text("no")
    got = {r["case_id"]: (r["origin"], r["placed_clean"]) for r in files.read_cases(spark, str(tmp_path), CASE).collect()}
    assert got == {"a": ("real", True), "b": ("real", True), "c": ("synthetic", False)}


def test_store(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "annotations": {"x": {"expected_clean": False, "violations": [{"rule_id": "TXT-01"}]}, "y": {"expected_clean": True}}}))
    got = {r["case_id"]: r["annotation"]["expected_clean"] for r in files.read_store(spark, str(tmp_path / "s.json"), schemas.STORE).collect()}
    assert got == {"x": False, "y": True}
    assert files.read_store(spark, str(tmp_path / "none.json"), schemas.STORE).count() == 0


def test_dimensions_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("rules:\n- {id: TXT-01, severity: high, category: c, title: t, description: 'first\n\n    second'}\n")
    assert files.read_rules(spark, str(tmp_path / "r.yaml")).first()["description"] == "first"
    (tmp_path / "bad.yaml").write_text("rules:\n- {id: TXT-1, severity: high}\n")
    with pytest.raises(ValueError, match="TXT-1"):
        files.read_rules(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "q.yaml").write_text("defaults: {high: 7}\noverrides: {TXT-20: 0}\n")
    assert files.read_quota(spark, str(tmp_path / "q.yaml")) == ({"high": 7}, {"TXT-20": 0})
    (tmp_path / "s.yaml").write_text("in_scope: [IMG-01]\nout_of_scope:\n- {id: IMG-02, reason: r}\n")
    assert files.read_scope(spark, str(tmp_path / "s.yaml")).count() == 2


def test_images_and_sources(spark, tmp_path):
    for s in ("one", "two", "images"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "cards.raw.jsonl").write_text("{}")
    assert sorted(r["source"] for r in files.find_sources(spark, str(tmp_path)).collect()) == ["one", "two"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a_0.png").write_bytes(b"x" * 10)
    got = files.read_images(spark, str(tmp_path / "img"), most=5)
    assert (r := got.first())["image_id"] == "a_0" and r["oversize"]
    assert files.to_download(spark.createDataFrame([("a_0",), ("a_1",)], "image_id string"), got).first()["image_id"] == "a_1"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a_1", 1), ("b_1", 2), ("a_1", 1)], "id string, v int")
    sinks.append_new(df, path, "id")
    sinks.append_new(spark.createDataFrame([("a_1", 9), ("c_1", 3)], "id string, v int"), path, "id")
    assert sorted((r["id"], r["v"]) for r in spark.read.schema("id string, v int").json(path).collect()) == [("a_1", 1), ("b_1", 2), ("c_1", 3)]
    path = str(tmp_path / "r")
    sinks.replace(df.limit(1), path, "parquet")
    sinks.replace(df.dropDuplicates(), path, "parquet")
    assert sinks.purge(spark, path, "id", "a") == 1 and sinks.current(spark, path).count() == 2
    assert sinks.purge(spark, path, "id", "a", confirm=True) == 1 and [r["id"] for r in sinks.current(spark, path).collect()] == ["b_1"]
    split = str(tmp_path / "split")
    assert sinks.write_split(df, df.where("v > 5"), split) == 0 and sinks.current(spark, split).count() == 3
    with pytest.raises(KeyError):
        sinks.current(spark, split, "rejected")
    assert sinks.write_split(df.where("v < 2"), df.where("v > 1"), split) == 1
    assert sinks.current(spark, split).count() == 2 and sinks.current(spark, split, "rejected").first()["id"] == "b_1"
    lines = sinks.table_lines(spark.createDataFrame([("x", 5), (None, None)], "s string, n int"), {"s": 3, "n": 4})
    assert [r[0] for r in lines.collect()] == ["x   |    5", "-   |    -"]


def test_write_changed_moves_rows(spark, tmp_path):
    from cardamom.operators.merge import change_flags

    path = str(tmp_path / "cases")
    old = spark.createDataFrame([(1, "a", "clean"), (2, "b", "clean")], "id int, v string, state string")
    sinks.replace(old, path, "parquet")
    new = spark.createDataFrame([(1, "a", "dirty"), (2, "b", "clean")], "id int, v string, state string")
    flags = change_flags(sinks.current(spark, path), new, "id", ["v"], "state").persist()
    assert sinks.write_changed(new, path, flags, "id", "state") == {"M": 1, "none": 1}
    assert {r["id"]: r["state"] for r in sinks.current(spark, path).collect()} == {1: "dirty", 2: "clean"}
    assert sinks.write_changed(new, path, flags.withColumn("change", F.lit("none")), "id", "state") == {"none": 2}


def test_crawl_tables(spark):
    maps = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc> m1 </loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"), ("m1", "<urlset><url><loc>p1</loc></url><url><loc>p?a=1&amp;b=2</loc></url></urlset>")], "url string, xml string")
    assert sorted(r[0] for r in crawl.sitemap_urls(maps, spark.createDataFrame([("r",)], "url string")).collect()) == ["p1", "p?a=1&b=2"]
    req = spark.createDataFrame([("h", "/a/b", 1), ("h", "/a/c", 2), ("g", "/a/b", 3)], "host string, path string, n int")
    robots = spark.createDataFrame([("h", "/a/", False), ("h", "/a/b", True)], "host string, prefix string, allow boolean")
    assert {r["n"]: r["allowed"] for r in crawl.allowed(req, robots).collect()} == {1: True, 2: False, 3: True}
    delays = spark.createDataFrame([("h", 5.0), ("g", 1.0)], "host string, delay double")
    assert {r["n"]: r["start"] for r in crawl.schedule(req, "host", "n", delays).collect()} == {1: 0.0, 2: 5.0, 3: 0.0}


def test_sitemaps_by_structure(spark):
    head = "<?xml version='1.0'?>"
    maps = [
        ("r", f"{head}<sm:sitemapindex xmlns:sm='s'><sm:sitemap><sm:loc>\n a </sm:loc></sm:sitemap><!-- <sm:sitemap><sm:loc>no</sm:loc></sm:sitemap> --><sm:sitemap><sm:loc>b</sm:loc></sm:sitemap></sm:sitemapindex>"),
        ("a", "<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc>r</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>"),
        ("b", f"{head}<urlset xmlns:i='i'><url><loc><![CDATA[p?x=1&y=2]]></loc><i:image><i:loc>img</i:loc></i:image></url><!-- <url><loc>hidden</loc></url> --><url><loc>q&amp;z</loc></url><url/><url><loc> </loc></url></urlset>"),
        ("no", "<urlset><url><loc>unseen</loc></url></urlset>"),
        ("c1", "<sitemapindex><sitemap><loc>c2</loc></sitemap></sitemapindex>"), ("c2", "<sitemapindex><sitemap><loc>c3</loc></sitemap></sitemapindex>"), ("c3", "<urlset><url><loc>deep</loc></url></urlset>"),
        ("broken", "<urlset><url><loc>x</loc>"), ("null", None),
    ]
    df = spark.createDataFrame(maps, "url string, xml string")

    def found(roots, depth=4):
        return sorted(r[0] for r in crawl.sitemap_urls(df, spark.createDataFrame([(x,) for x in roots], "url string"), depth).collect())

    # the indexes r and a lead to each other and to themselves
    assert found(["r"]) == found(["r"], 50) == ["p?x=1&y=2", "q&z"]
    assert found(["c1"]) == ["deep"] and found(["c1"], 1) == [] and found(["c1", "c3"], 0) == ["deep"]
    assert found(["broken", "null", "missing"]) == []


def test_streams(spark, tmp_path):
    rows = [(i % 50, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "view" if i % 2 else "click", 1.0, "{}") for i in range(120)] + [(999, "2024-01-02 00:00:00", 0, "view", 1.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    events = calls.read_events(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    calls.run_once(calls.windowed_metrics(events), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.agg(F.sum("calls")).first()[0] == 120
    calls.run_once(calls.distinct_calls(events), str(tmp_path / "d"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 51
    calls.run_once(calls.sessions(events), str(tmp_path / "s"), str(tmp_path / "cp3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).agg(F.sum("calls")).first()[0] == 120
    good, bad = str(tmp_path / "g"), str(tmp_path / "b")
    calls.route(events, str(tmp_path / "cp4"), lambda b: b.write.mode("overwrite").parquet(good), lambda b: b.write.mode("overwrite").parquet(bad), F.col("event_type") == "view").awaitTermination()
    assert spark.read.parquet(good).count() + spark.read.parquet(bad).count() == 121


def _flaky(calls_file):
    def factory():
        def client(n, name):
            with open(calls_file, "a") as f:
                f.write(f"{n}\n")
            if n is None or n % 3 == 0:
                raise ValueError(f"no {n}")
            return {"twice": n * 2, "other": 1}

        return client

    return factory


def test_calls_of_a_service(spark, tmp_path):
    from cardamom.sources import fetch

    rows = spark.createDataFrame([(i, f"n{i}", i) for i in range(1, 7)] + [(None, None, 9)], "n int, name string, twice int").coalesce(1)
    got = {r["name"]: r for r in fetch.called(rows, "twice bigint", _flaky(str(tmp_path / "calls")), ["n", "name"], retries=2, wait=lambda attempt, error: 0.0 if attempt < 1 or "6" in str(error) else None).collect()}
    assert [got[f"n{i}"]["twice"] for i in range(1, 7)] == [2, 4, None, 8, 10, None]
    assert got["n1"]["error"] is None and got["n3"]["error"] == "ValueError: no 3" and got[None]["error"] == "ValueError: no None"
    assert [got[f"n{i}"]["attempts"] for i in (1, 3, 6)] == [1, 2, 3]
    assert fetch.called(rows.where("false"), "twice bigint", _flaky(str(tmp_path / "calls")), ["n", "name"]).count() == 0


def test_calls_keep_to_their_rate(spark, tmp_path):
    import time

    from cardamom.sources import fetch

    rows = spark.range(6).select(F.col("id").cast("int").alias("n"), F.lit("x").alias("name")).coalesce(1)
    began = time.time()
    fetch.called(rows, "twice bigint", _flaky(str(tmp_path / "calls")), ["n", "name"], per_second=10).collect()
    assert time.time() - began >= 0.5


def test_a_failed_write_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3).toDF("v"), path, "parquet")
    with pytest.raises(Exception, match="no value"):
        sinks.replace(spark.range(3).select(F.raise_error(F.lit("no value")).cast("long").alias("v")), path, "parquet")
    assert sinks.current(spark, path).count() == 3


def test_all_tables_or_none(spark, tmp_path):
    path = str(tmp_path / "t")
    good, bad = (spark.createDataFrame([(1, s)], "v int, status string") for s in ("ok", "error"))
    assert sinks.commit_checked({"a": good, "b": good}, path) == 0
    assert sinks.commit_checked({"a": good.withColumn("v", F.lit(2)), "b": bad}, path) == 1
    assert [sinks.current(spark, path, t).first()["v"] for t in "ab"] == [1, 1] and sinks.current(spark, path, "a").columns == ["v"]


def test_stored_tables_go_with_the_session(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
from cardamom.session import stored
print("AT", stored(spark.range(5), "some").inputFiles()[0], stored(spark.range(5), "some").count())
"""
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert f"{tmp_path}/shared/cardamom/" in done.stdout and done.stdout.strip().endswith(" 5"), done.stderr[-1000:]
    for _ in range(100):
        if not list((tmp_path / "shared" / "cardamom").iterdir()):
            break
        import time

        time.sleep(0.1)
    assert not list((tmp_path / "shared" / "cardamom").iterdir())
