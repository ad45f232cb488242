"""Spark sessions with the settings that the engine is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: By application: folders of sessions on this machine that name none, and each one's part of its shared folder.
_own_dirs: dict[str, str] = {}
_parts: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once, so that functions which run in their Python workers find it.

    Nothing is sent if the package was itself shipped as an archive.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp()) / f"{root.name}-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, which spark.checkpoint.dir names.

    Where none is named, a session on this machine alone gets a folder of its own; any other is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="cardamom-"))
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, all of which goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _parts:
        part = f"{shared_dir(spark)}/cardamom/{app}-{uuid.uuid4().hex}"
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(part)
        fs = where.getFileSystem(jsc.hadoopConfiguration())
        # only what is there can be marked for removal
        if not (fs.mkdirs(where) and fs.deleteOnExit(where)):
            raise OSError(f"can't make {part}")
        _parts[app] = part
    return f"{_parts[app]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if its files make fewer splits than there are; any larger table as it is.

    For work that costs much more than moving the rows.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df._jdf.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    splits = sum(-(-p.getFileSystem(conf).getFileStatus(p).getLen() // split) for p in paths)
    return df.repartition(cores) if splits < cores else df


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench. On a cluster, the session is the caller's."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cardamom")
        .config("spark.driver.memory", os.environ.get("CARDAMOM_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
