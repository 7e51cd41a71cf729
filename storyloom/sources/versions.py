"""A table of statuses that several writers change: versions, commits that say which version they were made from, and
merging of what has been committed.

A commit is a Parquet table of changed rows and a small file with its version's number, which only one writer can create.
A writer that finds newer versions looks whether they changed the same keys: if so its commit is refused, else it is
numbered after them. Readers see whole versions only.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 20


class Conflict(Exception):
    """Newer versions changed keys of this commit."""


@dataclass
class Versions:
    """``path`` is a shared folder, ``keys`` name a row, ``schema`` has the keys and what is told of them."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def _create(self, number: int, entry: dict) -> bool:
        """Writes the file of a version unless there is one; of several writers one succeeds."""
        name, text = self._file(number), json.dumps(entry)
        if name.startswith("file:"):
            local = name.removeprefix("file://").removeprefix("file:")
            os.makedirs(os.path.dirname(local), exist_ok=True)
            # The name appears with its contents, and only once.
            with open(f"{local}.{uuid.uuid4().hex}", "w") as f:
                f.write(text)
            try:
                os.link(f.name, local)
            except FileExistsError:
                return False
            finally:
                os.remove(f.name)
            return True
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(name)
        fs = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(there, False)
        except Exception as e:  # the class of the error depends on the file system
            if fs.exists(there):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def log(self) -> list[dict]:
        """What every version is made of, from the last merged one on."""
        try:
            rows = self.spark.read.schema("number long, table string, merged boolean").json(f"{self.path}/versions/*.json").filter(F.col("number").isNotNull())
            last = rows.filter("merged").agg(F.max("number")).first()[0]
            found = rows.filter(F.col("number") >= (last or 0)).orderBy("number").collect()
        except AnalysisException:  # nothing is there yet
            return []
        out = []
        for r in found:
            if out and r.number != out[-1]["number"] + 1:
                break  # a version after one that is not there yet
            out.append(r.asDict())
        return out

    def version(self) -> int:
        """Number of the last version, 0 before the first."""
        log = self.log()
        return log[-1]["number"] if log else 0

    def read(self, number: int | None = None) -> DataFrame:
        """Rows as of a version, by default the last: of each key those of its last commit."""
        return self._read([e for e in self.log() if number is None or e["number"] <= number])

    def _tables(self, log: list[dict]) -> DataFrame | None:
        out = None
        for e in log:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{e['table']}").withColumn("number", F.lit(e["number"]).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _read(self, log: list[dict]) -> DataFrame:
        rows = self._tables(log)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        told = [c for c in T.StructType.fromDDL(self.schema).names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*told), "number").alias("t"))
        return last.select(*self.keys, "t.*")

    def _write(self, rows: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        rows.select(*T.StructType.fromDDL(self.schema).names).write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, changes: DataFrame, made_from: int) -> int:
        """Adds ``changes``, at most one row a key, that were made from version ``made_from``; gives the new version, or
        raises Conflict where a later one changed a key of theirs."""
        name = self._write(changes)
        mine = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").select(*self.keys)
        seen = made_from
        while True:
            log = self.log()
            newer = [e for e in log if e["number"] > seen and not e["merged"]]
            if log and log[0]["number"] > seen + 1:
                raise Conflict(f"version {made_from} has been merged away")
            theirs = self._tables(newer)
            if theirs is not None:
                same = [F.col(f"m.{k}").eqNullSafe(F.col(f"t.{k}")) for k in self.keys]
                if not mine.alias("m").join(theirs.alias("t"), same, "left_semi").isEmpty():
                    raise Conflict(f"versions {newer[0]['number']} to {newer[-1]['number']} changed the same rows")
            seen = log[-1]["number"] if log else 0
            if self._create(seen + 1, {"number": seen + 1, "table": name, "merged": False}):
                return seen + 1

    def change(self, make: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> int:
        """Commits what ``make`` makes of the last version; after a conflict it is made again from a newer one."""
        for _ in range(attempts):
            log = self.log()
            try:
                return self.commit(make(self._read(log)), log[-1]["number"] if log else 0)
            except Conflict as e:
                last = e
        raise last

    def merge(self) -> int:
        """Writes the last version as one table, a version of its own with the same rows; earlier ones are not read any
        more. Commits that were made from the version that is merged or a later one go on."""
        while True:
            log = self.log()
            if not log:
                return 0
            name, number = self._write(self._read(log)), log[-1]["number"] + 1
            if self._create(number, {"number": number, "table": name, "merged": True}):
                return number
