"""Tables that are replaced in one step: versioned folders, and a pointer that says which of them count.

    <path>/v-<id>/<table>/...     a version of a table, written once and never changed
    <path>/_pointers/<number>     which folder each table is in, as JSON; the greatest number counts

A commit writes folders that nobody reads yet, and then one small file, by a single rename to a name that
was free. Readers resolve the greatest pointer first, so at every moment they read all tables as one
commit left them. Tables that a commit doesn't replace keep their folders. A commit that stopped half-way has
left folders without a pointer, which recover() removes; it may also just be done again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTERS, WIDTH = "_pointers", 12


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


class Versions:
    """The tables of a folder, in any store that Spark writes to. `step` is called with the name of each step before it is done."""

    def __init__(self, spark: SparkSession, path: str, step: Callable[[str], None] = lambda name: None) -> None:
        self.spark, self.path, self._step = spark, path.rstrip("/"), step
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str) -> list[str]:
        where = self._at(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def numbers(self) -> list[int]:
        """Numbers of all commits that are still known."""
        return [int(n) for n in self._names(POINTERS) if n.isdigit()]

    def _pointer(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{POINTERS}/{number:0{WIDTH}}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
        finally:
            stream.close()

    def tables(self, number: int | None = None) -> dict[str, dict]:
        """Folder, format and schema of each table, now or as a commit left them; none before the first commit."""
        number = max(self.numbers(), default=None) if number is None else number
        return {} if number is None else self._pointer(number)["tables"]

    def read(self, table: str = "data", number: int | None = None) -> DataFrame:
        """A table, now or as a commit left it. KeyError if there is none of that name."""
        entry = self.tables(number)[table]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).format(entry["format"]).load(f"{self.path}/{entry['folder']}")

    def commit(self, tables: Mapping[str, DataFrame | None], format: str = "parquet", partition: str | None = None) -> int:
        """Replaces tables, all of them or none; None drops one. Returns the commit's number.

        A DataFrame may read the very tables that it replaces. CommitConflict if another writer was faster.
        """
        before = max(self.numbers(), default=0)
        entries = self.tables(before) if before else {}
        folder = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            if df is None:
                entries.pop(name, None)
                continue
            self._step(f"write {name}")
            writer = df.write.format(format)
            (writer.partitionBy(partition) if partition else writer).save(f"{self.path}/{folder}/{name}")
            entries[name] = {"folder": f"{folder}/{name}", "format": format, "schema": df.schema.jsonValue()}
        self._step("write pointer")
        own = uuid.uuid4().hex
        staged = self._at(f"{POINTERS}/.{own}")
        out = self._fs.create(staged, False)
        out.write(json.dumps({"commit": own, "tables": entries}).encode("utf-8"))
        out.close()
        self._step("rename pointer")
        number = before + 1
        target = self._at(f"{POINTERS}/{number:0{WIDTH}}")
        if self._fs.exists(target) or not self._fs.rename(staged, target) or self._pointer(number)["commit"] != own:
            self._fs.delete(staged, False)
            raise CommitConflict(f"{self.path} has a commit {number} of another writer")
        self._step("done")
        return number

    def recover(self, keep: int = 1) -> list[str]:
        """Removes what stopped commits left and all versions but the `keep` newest; returns the names of removed folders.

        For times when nobody writes, and when nobody reads older versions.
        """
        numbers = self.numbers()
        kept = numbers[-keep:] if keep > 0 else numbers[-1:]
        used = {entry["folder"].split("/")[0] for n in kept for entry in self.tables(n).values()}
        gone = [n for n in self._names("") if n.startswith("v-") and n not in used]
        # pointers go before the folders that they name
        for name in self._names(POINTERS):
            if not name.isdigit() or int(name) not in kept:
                self._fs.delete(self._at(f"{POINTERS}/{name}"), False)
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone
