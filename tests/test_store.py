"""Commit records, keyed tables and what is built on them: all or nothing, one winner, only touched buckets."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from asofspark.sources import io
from asofspark.sources.store import LostRace, Store

D = dt.date


def bars(spark, version, close="cast(k as double)", n=6):
    return spark.range(n).selectExpr("id as k").selectExpr("k as listing_id", "date '2020-01-01' + cast(k as int) as session_date", "'s' as source_id", f"{close} as close", "k as volume", f"'{version}' as dataset_version_id", "'E' as exchange")


def read(spark, root, version):
    return io.read_bars(spark, root, version, "2020-01-01", "2020-12-31")


def test_bars_are_brought_to_the_schema(spark, tmp_path):
    for k, close in enumerate(("k", "cast(k as int)", "cast(k / 4 as decimal(12, 4))", "cast(k as float)")):
        io.write_bars(bars(spark, f"v{k}", close), str(tmp_path))
        got = read(spark, str(tmp_path), f"v{k}")
        assert got.schema == io.BARS and [r.close for r in got.orderBy("listing_id").collect()][1] in (0.25, 1.0)
    for wrong in ("cast(k as string)", "k + 9007199254740993"):  # another kind, and numbers that a double can't hold
        with pytest.raises(Exception, match="close"):
            io.write_bars(bars(spark, "w", wrong), str(tmp_path))
    with pytest.raises(Exception, match="volume can't hold 0.5"):
        io.write_bars(bars(spark, "w").withColumn("volume", F.lit(0.5)), str(tmp_path))
    with pytest.raises(ValueError, match="exchange"):
        io.ensure_bars(bars(spark, "w").drop("exchange"), str(tmp_path))
    with pytest.raises(ValueError, match="multiplier"):
        io.ensure_factors(bars(spark, "w"), str(tmp_path))
    assert read(spark, str(tmp_path), "w").count() == 0


def test_a_failure_between_data_and_commit_shows_nothing(spark, tmp_path, monkeypatch):
    both = bars(spark, "a").unionByName(bars(spark, "b/=c"))
    with monkeypatch.context() as m:
        m.setattr(Store, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            io.write_bars(both, str(tmp_path))
    assert read(spark, str(tmp_path), "a").count() == read(spark, str(tmp_path), "b/=c").count() == 0
    assert io.write_bars(both, str(tmp_path)) == ["a", "b/=c"]
    assert read(spark, str(tmp_path), "a").count() == read(spark, str(tmp_path), "b/=c").count() == 6
    store = Store(spark, str(tmp_path))
    assert len(store.vacuum()) == 1 and read(spark, str(tmp_path), "a").count() == 6


def test_of_two_writers_of_a_version_one_wins_whole(spark, tmp_path):
    def write(k):
        try:
            io.write_bars(bars(spark, "same", f"cast({k} as double)").unionByName(bars(spark, f"own{k}")), str(tmp_path))
            return k
        except io.ImmutableTargetError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(write, range(4)) if k is not None]
    assert len(won) == 1
    assert {r.close for r in read(spark, str(tmp_path), "same").collect()} == {float(won[0])}
    assert [read(spark, str(tmp_path), f"own{k}").count() for k in range(4)] == [6 if k == won[0] else 0 for k in range(4)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: io.write_bars(bars(spark, f"other{k}"), str(tmp_path)), range(3)))
    assert all(read(spark, str(tmp_path), f"other{k}").count() == 6 for k in range(3))
    assert Store(spark, str(tmp_path)).head().number == 4


def test_updates_touch_their_buckets_only_and_start_again_when_late(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path), buckets=8), StructType.fromDDL("k long, v long")

    def put(rows, mark=None, between=lambda: None):
        def make(commit):
            touched = store.touched(rows, ["k"])
            old = store.read("t", schema, touched, commit)
            between()
            return {"t": (old.unionByName(rows).groupBy("k").agg(F.sum("v").alias("v")), ["k"], touched)}

        return store.update(make, mark)

    put(spark.range(100).selectExpr("id as k", "1L as v"))
    before = store.head()
    assert len(before.folders["t"]) == 8
    assert put(spark.sql("select 5L as k, 10L as v"), ("s", 3)) and not put(spark.sql("select 5L as k, 10L as v"), ("s", 3))
    after = store.head()
    assert sum(before.folders["t"][b] != after.folders["t"][b] for b in after.folders["t"]) == 1
    turns = iter([lambda: put(spark.sql("select 5L as k, 100L as v")), lambda: None])
    put(spark.sql("select 5L as k, 1000L as v"), between=lambda: next(turns)())  # another writer is first
    assert {r.k: r.v for r in store.read("t", schema).collect()} == {k: 1 + 1110 * (k == 5) for k in range(100)}
    with pytest.raises(LostRace):
        put(spark.sql("select 5L as k, 1L as v"), between=lambda: store.publish(store.head(), {}))
    store.vacuum()
    assert store.read("t", schema).count() == 100
