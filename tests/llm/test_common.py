"""Tables in the shared folder, and batches bounded by bytes."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardamom import session
from cardamom.llm import common

ROOT = Path(__file__).resolve().parents[2]

PLAIN = """
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
from cardamom.llm import mtree
from cardamom.session import shared_dir
before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
vectors = spark.range(30).select(F.col("id").alias("vec_id"), F.array(F.col("id"), F.col("id") % 7).alias("v"))
assert mtree.top_k(vectors, F.col("vec_id") % 20 == 0, k=3).count() == 6
assert shared_dir(spark) == shared_dir(spark)
assert before == {k: spark.conf.get(k) for k in before}
"""


def test_a_session_without_a_shared_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_must_name_its_folder():
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_parts_are_bounded_by_bytes():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 30, "d" * 31, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"])
    got = list(common.parts(batch, ["t"], 60))
    assert [x for p in got for x in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 60 for p in got)
    assert len(got) == 4 and list(common.parts(batch.slice(0, 0), ["t"])) == []


def test_stored_tables_can_be_discarded(spark):
    df = common.stored(spark.range(5), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    common.discard(spark, df)
    assert not os.path.isdir(path)


def test_small_counts_rows_and_bytes(spark):
    df = spark.range(10).select(F.array_repeat(F.lit(1), 100).alias("a"))
    assert common.small(df, 10) and not common.small(df, 9)
    assert not common.small(df, 10, F.size("a").cast("long") * common.BROADCAST_BYTES)
    assert common.small(df.where("false"), 0, F.size("a"))


def test_workers_give_memory_back(spark):
    """What a task freed is the machine's again when the next task of the same worker begins, even if something small stays behind it."""

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

    def large():
        def kernel(texts):
            import builtins

            before, held = resident(), [bytes(700) for _ in range(300_000)]
            builtins.kept_by_test, after = held[-1], resident()
            return [[os.getpid()] * len(texts), [before] * len(texts), [after] * len(texts)]

        return kernel

    def small():
        return lambda texts: [[os.getpid()] * len(texts), [resident()] * len(texts), [0.0] * len(texts)]

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    made = "pid long, mb double, most double"
    first = common.map_text(docs.coalesce(1), made, large).collect()[0]
    assert first["most"] > first["mb"] + 150
    then = [r["mb"] for r in common.map_text(docs.repartition(16), made, small).collect() if r["pid"] == first["pid"]]
    assert then and max(then) < first["mb"] + 50
