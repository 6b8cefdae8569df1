"""Immutable Parquet tables of bars and factors: all versions of a write appear by one commit, pruned range reads.

Rows are brought to the table's schema before they are written; a missing column, a type of another kind or a value that
the schema's type can't hold exactly is an error. Columns that the schema doesn't have don't travel."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Commit, LostRace, Store

KEY = [T.StructField("listing_id", T.LongType()), T.StructField("session_date", T.DateType()), T.StructField("source_id", T.StringType())]
BARS = T.StructType([*KEY, T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType()), T.StructField("dataset_version_id", T.StringType()), T.StructField("exchange", T.StringType()), T.StructField("year", T.IntegerType())])
FACTORS = T.StructType([*KEY, T.StructField("multiplier", T.DoubleType()), T.StructField("dataset_version_id", T.StringType()), T.StructField("year", T.IntegerType())])
#: Rows of a file at most, and the folder name that Spark gives to NULL.
MOST_RECORDS, NO_VERSION = 5_000_000, "__HIVE_DEFAULT_PARTITION__"


class ImmutableTargetError(ValueError):
    """The target holds other content, or a part of it."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its types. Numbers become other numbers, and times dates, where every value stays the same."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kinds = {T.NumericType: T.NumericType, T.DateType: (T.TimestampType, T.TimestampNTZType)}
    out = []
    for f in schema:
        have, column = df.schema[f.name].dataType, F.col(f"`{f.name}`")
        if have == f.dataType:
            out.append(column)
            continue
        if not any(isinstance(f.dataType, to) and isinstance(have, of) for to, of in kinds.items()):
            raise ValueError(f"{f.name} is {have.simpleString()}, not {f.dataType.simpleString()}")
        cast = column.try_cast(f.dataType)
        same = cast.try_cast(have).eqNullSafe(column)
        out.append(F.when(same, cast).otherwise(F.raise_error(F.concat(F.lit(f"{f.name} can't hold "), column.cast("string"))).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def _aside(df: DataFrame, store: Store, schema: T.StructType, parts: list[str]) -> dict[str, str]:
    """Write all versions in one pass to a folder that no commit names yet; version -> folder. Targets of many rows go to
    several tasks and files, as adaptive execution rebalances them."""
    keys, top = ["dataset_version_id", *parts], f"data-{uuid.uuid4().hex}"
    rows = conform(df.withColumn("year", F.year("session_date")), schema)
    ordered = rows.hint("rebalance", *[F.col(c) for c in keys]).sortWithinPartitions(*keys, "listing_id", "session_date")
    ordered.write.option("maxRecordsPerFile", MOST_RECORDS).partitionBy(*keys).parquet(f"{store.root}/{top}")
    names = sorted(f.getPath().getName() for f in store.fs.listStatus(store.path(f"{store.root}/{top}")) if f.isDirectory())
    plain = store.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return {plain(n.split("=", 1)[1]): f"{top}/{n}" for n in names}


def _drop(store: Store, folders: dict[str, str]) -> None:
    for top in {f.split("/")[0] for f in folders.values()}:
        store.fs.delete(store.path(f"{store.root}/{top}"), True)


def _versions(commit: Commit) -> dict[str, str]:
    return commit.folders.get("versions", {})


def _publish(store: Store, folders: dict[str, str], tries: int = 100) -> list[str]:
    """One commit for all versions. Of two writers of a version one is first; the other gets an error, and nothing of its
    write becomes visible."""
    for _ in range(tries):
        head = store.head()
        taken = [v for v in folders if v in _versions(head) or v == NO_VERSION]
        if taken:
            _drop(store, folders)
            raise ImmutableTargetError(f"already written, or without version: {taken}")
        if not folders or store.publish(head, {"versions": folders}):
            return sorted(folders)
    _drop(store, folders)
    raise LostRace(f"{tries} times another writer was first")


def _write(df: DataFrame, root: str, schema: T.StructType, parts: list[str]) -> list[str]:
    store = Store(df.sparkSession, root)
    return _publish(store, _aside(df, store, schema, parts))


def write_bars(df: DataFrame, root: str) -> list[str]:
    """Write by (dataset_version_id, exchange, year); any existing version is an error before anything becomes visible."""
    return _write(df, root, BARS, ["exchange", "year"])


def write_factors(df: DataFrame, root: str) -> list[str]:
    return _write(df, root, FACTORS, ["year"])


def _folder(store: Store, folder: str, schema: T.StructType) -> DataFrame:
    return store.spark.read.schema(schema).option("basePath", f"{store.root}/{folder.split('/')[0]}").parquet(f"{store.root}/{folder}")


def _read(spark: SparkSession, root: str, schema: T.StructType, version: str, start: str, end: str) -> DataFrame:
    if end < start:
        raise ValueError("end before start")
    store = Store(spark, root)
    folder = _versions(store.head()).get(version)
    if folder is None:
        return spark.createDataFrame([], schema)
    years = (F.col("year") >= int(start[:4])) & (F.col("year") <= int(end[:4]))
    return _folder(store, folder, schema).where(years & F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_bars(spark: SparkSession, root: str, version: str, start: str, end: str, listing_id: int | None = None) -> DataFrame:
    """Bars of a version between two days, both inclusive: the commit gives the version's folder, partitions are pruned by
    year, row groups by date."""
    df = _read(spark, root, BARS, version, start, end)
    return df if listing_id is None else df.where(F.col("listing_id") == listing_id).orderBy("session_date", "source_id")


def read_factors(spark: SparkSession, root: str, version: str, start: str, end: str, listing_id: int | None = None) -> DataFrame:
    df = _read(spark, root, FACTORS, version, start, end)
    return df if listing_id is None else df.where(F.col("listing_id") == listing_id).orderBy("session_date", "source_id")


def _ensure(df: DataFrame, root: str, schema: T.StructType, parts: list[str]) -> str:
    store = Store(df.sparkSession, root)
    folders = _aside(df, store, schema, parts)
    there = {v: f for v, f in _versions(store.head()).items() if v in folders}
    if not there:
        _publish(store, folders)
        return "written"
    try:
        if len(there) < len(folders):
            raise ImmutableTargetError(f"only some versions are present: {sorted(there)}")
        for v, folder in folders.items():
            new, old = (_folder(store, f, schema).select(*schema.names) for f in (folder, there[v]))
            if not (new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()):
                raise ImmutableTargetError(f"content differs: {v}")
        return "unchanged"
    finally:
        _drop(store, folders)


def ensure_bars(df: DataFrame, root: str) -> str:
    """Idempotent write: absent versions are written, present and equal ones left, anything else is an error."""
    return _ensure(df, root, BARS, ["exchange", "year"])


def ensure_factors(df: DataFrame, root: str) -> str:
    return _ensure(df, root, FACTORS, ["year"])
