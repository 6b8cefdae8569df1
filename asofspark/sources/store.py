"""Parquet tables behind a commit record: what a commit names becomes visible at once, or not at all.

A commit is one small JSON file, ``_commits/<number>.json``, that names the folder of every part of every table (a dataset
version, or a hash bucket of a keyed table) and the batches that went into them. Data go to folders of their own first; the
next commit file then appears whole under a number that only one writer gets. A writer that comes second starts again from
the commit that was first. Readers take the newest commit; folders that no commit names are never read.

Keyed tables are cut into ``buckets`` by a hash of their keys: an update reads and rewrites only the buckets of its rows.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class LostRace(RuntimeError):
    """Other writers were first as often as was tried."""


@dataclass
class Commit:
    """folders: table name -> part -> folder below the root; marks: stream -> its newest batch; schemas: of keyed tables."""

    number: int = 0
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)


class Store:
    """The tables of one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- commits ---------------------------------------------------------------------------------------------------

    def head(self) -> Commit:
        """The newest commit."""
        top = self.path(f"{self.root}/_commits")
        if not self.fs.exists(top):
            return Commit()
        numbers = [int(n.split(".")[0]) for f in self.fs.listStatus(top) if (n := f.getPath().getName()).endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return Commit()
        stream = self.fs.open(self.path(f"{self.root}/_commits/{max(numbers):012d}.json"))
        try:
            return Commit(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def publish(self, base: Commit, changes: dict[str, dict[str, str | None]], mark: tuple[str, int] | None = None, schemas: dict[str, dict] | None = None) -> bool:
        """Make ``base`` with ``changes`` (a part without folder goes) the next commit; False if its number is taken."""
        folders = {name: dict(parts) for name, parts in base.folders.items()}
        for name, parts in changes.items():
            own = folders.setdefault(name, {})
            for part, folder in parts.items():
                own.pop(part, None)
                if folder is not None:
                    own[part] = folder
        after = Commit(base.number + 1, folders, base.marks | (dict([mark]) if mark else {}), base.schemas | (schemas or {}))
        aside, target = (self.path(f"{self.root}/_commits/{n}") for n in (f"_{uuid.uuid4().hex}", f"{after.number:012d}.json"))
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(after.__dict__).encode()))
        out.close()
        try:
            return self._named(aside, target)
        finally:
            self.fs.delete(aside, False)

    def _named(self, aside, target) -> bool:
        """Give the file its final name unless that is taken, as one step: a hard link on local disks, where a rename would
        replace a file, and a rename elsewhere."""
        if self.fs.getScheme() != "file":
            return self.fs.rename(aside, target)
        paths = self.spark._jvm.java.nio.file.Paths
        at = lambda p: paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.String, 0))
        try:
            self.spark._jvm.java.nio.file.Files.createLink(at(target), at(aside))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def update(self, make: Callable[[Commit], dict[str, tuple[DataFrame, Sequence[str], Sequence[int]]]], mark: tuple[str, int] | None = None, tries: int = 10) -> bool:
        """Write what ``make`` makes of the newest commit: by table the new rows of the touched buckets, the keys and those
        buckets. All tables become visible together. A batch that is marked as done changes nothing (False)."""
        for _ in range(tries):
            base = self.head()
            if mark and base.marks.get(mark[0], -1) >= mark[1]:
                return False
            made = make(base)
            changes = {name: self.write(name, rows, keys, touched) for name, (rows, keys, touched) in made.items()}
            if self.publish(base, changes, mark, {name: rows.schema.jsonValue() for name, (rows, _, _) in made.items()}):
                return True
            for parts in changes.values():
                for folder in {f.rsplit("/", 1)[0] for f in parts.values() if f}:
                    self.fs.delete(self.path(f"{self.root}/{folder}"), True)
        raise LostRace(f"{tries} times another writer was first")

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest commit doesn't name; returns them. Readers of older commits lose theirs."""
        named = {f.split("/")[0] for parts in self.head().folders.values() for f in parts.values()}
        gone = [n for f in self.fs.listStatus(self.path(self.root)) if not (n := f.getPath().getName()).startswith(("_", ".")) and n not in named]
        for n in gone:
            self.fs.delete(self.path(f"{self.root}/{n}"), True)
        return gone

    def rested(self, df: DataFrame, label: str) -> DataFrame:
        """Cut the lineage: ``df`` from a folder of this store that no commit names."""
        path = f"{self.root}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # -- keyed tables ----------------------------------------------------------------------------------------------

    def bucket(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, keys: Sequence[str]) -> list[int]:
        """The buckets of the rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(keys)).distinct().collect())

    def write(self, name: str, rows: DataFrame, keys: Sequence[str], touched: Sequence[int]) -> dict[str, str | None]:
        """New folders of the touched buckets, in one pass; a bucket left without rows has none."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket(keys)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        there = {f.getPath().getName() for f in self.fs.listStatus(self.path(f"{self.root}/{folder}")) if f.isDirectory()}
        return {str(b): f"{folder}/_bucket={b}" if f"_bucket={b}" in there else None for b in touched}

    def read(self, name: str, schema: StructType | None = None, touched: Sequence[int] | None = None, commit: Commit | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, as of a commit. ``schema`` is for a table that isn't there yet."""
        commit = commit or self.head()
        if name in commit.schemas:
            schema = StructType.fromJson(commit.schemas[name])
        elif schema is None:
            raise KeyError(f"no table {name}")
        folders = [f for b, f in sorted(commit.folders.get(name, {}).items()) if touched is None or int(b) in touched]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local master may go without one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def rested(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it back, so that a lost executor costs the
    unfinished step only."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
