"""Versioned table folders: every commit writes new files for what it changes, then puts one version file in place that names all parts of all tables.

Plain Parquet has no MERGE or DELETE. A table is cut into BUCKETS by the hash of its key, so that a merge rewrites only the buckets it touches. A reader sees one version, whole or not at all.
The version file v<n>.json is renamed to where none may be yet: of two writers of one version the second fails and loses nothing but its own work. A crash leaves
files that no version names; the next compaction removes them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.schemas import TABLES, migrated, schema

BUCKETS = 32
_VERSION = re.compile(r"v(\d+)\.json")


class Conflict(RuntimeError):
    """Another commit came first."""


class Snapshot:
    """The tables of one knowledge base under a folder any executor can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self) -> dict:
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        versions = [int(m[1]) for n in names if (m := _VERSION.fullmatch(n))]
        if not versions:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/v{max(versions)}.json", wholetext=True).first()[0])

    @property
    def version(self) -> int:
        return self._read()["version"]

    def table(self, name: str) -> DataFrame:
        """A table of the current version; one never written is empty. Columns added since take their defaults."""
        return self._rows(name, self._read()["tables"].get(name))

    def _rows(self, name: str, parts: dict[str, str] | None, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{name}/{folder}/b={b}" for b, folder in (parts or {}).items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema(name))
        return migrated(self.spark.read.parquet(*paths), name)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(schema(name).fieldNames()[0]), F.lit(BUCKETS)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """{bucket: folder} of newly written rows."""
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        folder = f"w-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}/{folder}"
        migrated(rows, name).withColumn("b", self._bucket(name)).repartition(F.col("b")).write.partitionBy("b").parquet(at)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))]
        return {n[2:]: folder for n in found if n.startswith("b=")}

    def commit(self, changes: dict[str, DataFrame], expected: int | None = None) -> int:
        """Replaces the changed tables together. Raises Conflict if the version is no longer `expected` or another commit comes first."""
        now = self._expected(expected)
        return self._publish(now, {name: self._write(name, df) for name, df in changes.items()})

    def merge(self, changes: dict[str, DataFrame], put, expected: int | None = None) -> int:
        """Puts rows into tables by key: of each table only the buckets that the rows fall in are read, changed by put(name, old rows, new rows) and written."""
        now, tables = self._expected(expected), {}
        for name, rows in changes.items():
            touched = sorted(r[0] for r in rows.select(self._bucket(name).alias("b")).distinct().collect())  # at most BUCKETS
            old = now["tables"].get(name, {})
            tables[name] = {k: v for k, v in old.items() if int(k) not in touched} | self._write(name, put(name, self._rows(name, old, touched), rows))
        return self._publish(now, tables)

    def _expected(self, expected: int | None) -> dict:
        now = self._read()
        if expected is not None and now["version"] != expected:
            raise Conflict(f"version is {now['version']}, not {expected}")
        return now

    def _publish(self, now: dict, tables: dict[str, dict[str, str]]) -> int:
        version = now["version"] + 1
        temporary, final = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/v{version}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"version": version, "tables": now["tables"] | tables}).encode()))
        out.close()
        try:
            self._put(temporary, final)
        except Exception as error:
            self._fs.delete(temporary, False)
            raise Conflict(f"version {version} was committed by another writer") from error
        return version

    def _put(self, temporary, final) -> None:
        """One file renamed to where none may be, in one step."""
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(temporary, final, how)

    def compact(self, small: int = 16 << 20) -> int:
        """Rewrites tables whose files are on average under `small` bytes with one file a bucket, then removes version files and folders that the current version does not name; returns how many."""
        now, packed = self._read(), {}
        for name, parts in now["tables"].items():
            sizes = [f.getLen() for b, folder in parts.items() for f in self._fs.listStatus(self._path(f"{self.root}/{name}/{folder}/b={b}")) if f.getPath().getName().endswith(".parquet")]
            if len(sizes) > len(parts) and sum(sizes) < small * len(sizes):
                packed[name] = self._write(name, self._rows(name, parts))
        if packed:
            self._publish(now, packed)
            now = self._read()
        removed = 0
        for name in TABLES:
            folder, used = self._path(f"{self.root}/{name}"), {(f, b) for b, f in now["tables"].get(name, {}).items()}
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                own = status.getPath().getName()
                for part in self._fs.listStatus(status.getPath()):
                    if part.getPath().getName().startswith("b=") and (own, part.getPath().getName()[2:]) not in used:
                        self._fs.delete(part.getPath(), True)
                        removed += 1
                if own not in {f for f, _ in used}:
                    self._fs.delete(status.getPath(), True)
        for status in self._fs.listStatus(self._path(self.root)):
            found = _VERSION.fullmatch(status.getPath().getName())
            if found and int(found[1]) < now["version"]:
                self._fs.delete(status.getPath(), False)
        return removed

    def reset_book(self, book_id: str) -> int:
        """Removes a book from every table that has books."""
        left = {n: self.table(n).where(~F.col("book_id").eqNullSafe(F.lit(book_id))) for n in self._read()["tables"] if "book_id" in schema(n).fieldNames()}
        return self.commit(left)
