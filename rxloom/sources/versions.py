"""Tables that are upserted in place: versions by key bucket, committed by one rename.

A table is a folder. ``data/<version>/bucket_=<k>`` holds the rows whose key hashes to k,
as the version wrote them; ``commits/<n>`` is the n-th commit, a JSON file that names
the version of each bucket. Whoever opens the table reads the commit with the highest
number. An upsert reads and writes only the buckets that its keys hash to, into a new
folder that no commit names yet, and then moves its commit into place under the next
number. Where another writer has taken that number, the upsert starts again from what
that one wrote. A write that fails leaves a folder that nothing names; ``vacuum`` removes
such folders, and the versions that only older commits need.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rxloom.operators.linkage import first_by

#: Buckets of a new table: a commit names each, so it stays small.
BUCKETS = 64
#: Times that an upsert starts again after other writers' commits.
TRIES = 8
_DIGITS = 12


class Conflict(RuntimeError):
    """Another writer took the commit's number."""


class VersionedTable:
    """A table of rows with a unique key, in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._hadoop, self._where = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path
        self._fs = self._where(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names and times (ms) of what a folder holds; none if it isn't there."""
        where = self._where(f"{self.path}/{folder}")
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _put(self, name: str, text: str) -> None:
        """Writes a small file and moves it to ``name``, which must not be there."""
        part, whole = self._where(f"{self.path}/staged/{uuid.uuid4().hex}"), self._where(f"{self.path}/{name}")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(whole.getParent())
        gateway = self.spark.sparkContext._gateway
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(part), self._fs.makeQualified(whole), gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0))
        except Py4JJavaError as error:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(name) from None
            raise

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._where(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # reading

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(n) for n, _ in self._names("commits") if n.isdigit()), default=0)

    def _commit(self, version: int) -> dict:
        return json.loads(self._get(f"commits/{version:0{_DIGITS}}"))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named; of some buckets only, if such are named.

        The files of a version don't change, so a reader keeps what it opened.
        """
        version = self.version() if version is None else version
        if not version:
            raise FileNotFoundError(f"{self.path} has no version")
        commit = self._commit(version)
        schema = StructType.fromJson(commit["schema"])
        paths = [f"{self.path}/data/{v}/bucket_={k}" for k, v in commit["buckets"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("bucket_", F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int"))

    def upsert(self, new: DataFrame, order: list[str], before_commit: Callable[[], None] | None = None) -> int:
        """Puts the rows of ``new`` in place of those with their key, or beside them, and returns the version that holds them.

        Of rows with one key the last in ``order`` counts, null keys are left out.
        Where every row is there already, nothing is written and the version stays.
        ``new`` is read twice or more and must not change. ``before_commit`` runs
        when all is written and nothing is visible yet.
        """
        if "bucket_" in (c.lower() for c in new.columns):
            raise ValueError("a column can't have the name of the folders, bucket_")
        latest = first_by(new.filter(F.col(self.key).isNotNull()), [self.key], [F.desc(c) for c in order])
        for _ in range(TRIES):
            try:
                return self._upserted(latest, before_commit)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} other commits came first")

    def _upserted(self, latest: DataFrame, before_commit: Callable[[], None] | None) -> int:
        base = self.version()
        commit = self._commit(base) if base else {"buckets": {}, "of": self.buckets, "schema": json.loads(latest.schema.json())}
        latest = self._bucketed(latest.select(StructType.fromJson(commit["schema"]).names), commit["of"])
        columns = [c for c in latest.columns if c != "bucket_"]
        name = uuid.uuid4().hex
        if base:
            # rows that are there as they are change nothing, and their buckets stay
            touched = [r[0] for r in latest.select("bucket_").distinct().collect()]
            old = self._bucketed(self.read(base, touched), commit["of"])
            same = F.lit(True)
            for c in columns:
                same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
            changed = latest.alias("n").join(old.alias("o"), same & (F.col("n.bucket_") == F.col("o.bucket_")), "left_anti")
            touched = [r[0] for r in changed.select("bucket_").distinct().collect()]
            if not touched:
                return base
            held = F.col("bucket_").isin(touched)
            kept = old.filter(held).join(latest.filter(held).select("bucket_", self.key), ["bucket_", self.key], "left_anti")
            latest = kept.select(*columns, "bucket_").unionByName(latest.filter(held))
        try:
            # buckets are parts of any size, which adaptive execution cuts where they are large
            latest.hint("rebalance", "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{name}")
            if before_commit:
                before_commit()
            written = [n.split("=")[1] for n, _ in self._names(f"data/{name}") if n.startswith("bucket_=")]
            commit = commit | {"buckets": commit["buckets"] | dict.fromkeys(written, name)}
            self._put(f"commits/{base + 1:0{_DIGITS}}", json.dumps(commit))
        except BaseException:
            self._fs.delete(self._where(f"{self.path}/data/{name}"), True)
            raise
        return base + 1

    def vacuum(self, keep: int = 2, older_ms: int = 86_400_000) -> int:
        """Deletes commits but the last ``keep``, and folders that no commit names, if they are older than ``older_ms``, so that no running write or read loses files; returns how many folders went."""
        last, due = self.version(), time.time() * 1000 - older_ms
        live: set[str] = set()
        for n, at in [(int(n), at) for n, at in self._names("commits") if n.isdigit()]:
            if n <= last - keep and at <= due:
                self._fs.delete(self._where(f"{self.path}/commits/{n:0{_DIGITS}}"), False)
            else:
                live |= set(self._commit(n)["buckets"].values())
        gone = [n for n, at in self._names("data") if n not in live and at <= due]
        for n in gone:
            self._fs.delete(self._where(f"{self.path}/data/{n}"), True)
        return len(gone)
