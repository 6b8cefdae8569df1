"""Shared helpers of the training-data operators: table reading, row keys and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Stands for a missing doc_id: such rows come after all others.
LAST_ID = (1 << 63) - 1
#: Names of key columns beside those of a user's table.
KEY = ("__row_id", "__row_hash")
#: Bytes of rows that a Python worker takes at a time.
BATCH_BYTES = 4_000_000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local master may go without one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it back.

    The files outlive any executor, so that a lost one costs the unfinished step only.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stash_path = path
    _kept.append(kept)
    return kept


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, _id, _h): ``_id`` orders rows (null last), (_id, _h) tells texts of one id apart.

    Rows that repeat both id and text share a key, and so the same result.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    ).withColumns({"_id": F.coalesce("doc_id", F.lit(LAST_ID)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def keyed_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEY[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), KEY[1]: F.xxhash64(F.coalesce("text", F.lit("")))})


#: The tables from ``stash`` that this driver has not deleted yet.
_kept: list[DataFrame] = []


def stash_only(made: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stash what ``made`` returns and then delete every table that ``made`` has stashed on its way."""
    before = len(_kept)
    out = stash(made(), label)
    discard(*_kept[before:-1])
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete tables from ``stash`` whose consumers have all been written."""
    for df in stashed:
        _kept[:] = [x for x in _kept if x is not df]
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes: a worker holds a few megabytes of rows at a time, or one longer row.

    The session's bound on a batch's bytes is lowered to BATCH_BYTES if it is greater; the worker gives free Arrow memory
    back when a task ends.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, f"{1 << 30}b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def beside(docs: DataFrame, columns: Iterable[str], **given: Column) -> DataFrame:
    """``given`` and the named columns of a user's table as one struct ``kept``, its fields by number, so that no name of
    theirs, with dots or like one of ours, meets another on the way to the Python workers or in joins."""
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]
    return docs.select(*[c.alias(n) for n, c in given.items()], F.struct(F.lit(None).cast("int").alias("none"), *fields).alias("kept"))


def kept_arrays(batch: pa.RecordBatch) -> list[pa.Array]:
    """The columns in ``kept``."""
    return batch.column("kept").flatten()[1:]


def kept_columns(columns: Iterable[str]) -> list[Column]:
    return [F.col("kept").getField(f"c{k}").alias(c) for k, c in enumerate(columns)]


def kept_schema(rows: DataFrame, columns: Iterable[str]) -> StructType:
    return StructType([StructField(c, f.dataType) for c, f in zip(columns, list(rows.schema["kept"].dataType)[1:], strict=True)])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows and bytes, so that a worker holds the Python objects of a few texts at a time."""
    for b in batches:
        step = min(rows, max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def binaries(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def component_labels(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of an edge table (a long, b long): rows (node, component = smallest node).

    Every round hangs each node on the smallest node known to it or to its neighbours and then halves the
    paths, by joins; the rounds grow with the logarithm of the longest path. Rounds are written to the shared
    scratch folder, only counts come to the driver.
    """
    some = edges.where("a <> b").select("a", "b")
    both = stash(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    state = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), f"{label}-round")
    while True:
        here, there = state.select(F.col("node").alias("a"), "component"), state.select(F.col("node").alias("b"), F.col("component").alias("offer"))
        # what a neighbour knows, for the node itself and for the node it hangs on; and what the node knew
        seen = both.join(there, "b").join(here, "a").select(F.explode(F.array("a", "component")).alias("node"), F.lit(None).cast("long").alias("old"), "offer")
        best = seen.unionByName(state.select("node", F.col("component").alias("old"), F.col("component").alias("offer"))).groupBy("node").agg(F.max("old").alias("old"), F.min("offer").alias("c"))
        parent = state.select(F.col("node").alias("c"), F.col("component").alias("further"))
        nearer = best.join(parent, "c", "left").select("node", "old", F.least("c", "further").alias("component"))
        nearer, before = stash(nearer, f"{label}-round"), state
        changed = not nearer.where("component <> old").isEmpty()
        discard(before)
        if not changed:
            discard(both)
            return nearer.select("node", "component")
        state = nearer
