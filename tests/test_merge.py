"""Merges of parts, in any order, against one call over all rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofspark.operators import pit, scd
from asofspark.sources import merge
from asofspark.sources.store import Store

DAY = dt.date(2020, 1, 1)


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def parts(rows, n, seed):
    r = random.Random(seed)
    dealt = [[] for _ in range(n)]
    for row in r.sample(rows, len(rows)):
        r.choice(dealt).append(row)
    return dealt


@pytest.fixture(scope="module")
def seen():
    r = random.Random(5)
    return [(r.choice([None, *range(12)]), DAY + dt.timedelta(days=r.randrange(8)), r.choice(["a", "a", "b", None])) for _ in range(150)]


def test_slowly_changing_tables(spark, tmp_path, seen):
    schema, columns = "k int, at date, v string", (["k"], "at", ["v"])
    every, store = spark.createDataFrame(seen, schema), Store(spark, str(tmp_path), buckets=4)
    for k, part in enumerate(parts(seen, 3, 1)):
        df = spark.createDataFrame(part, schema)
        assert merge.scd2(store, "s", df, *columns, mark=("feed", k)) and not merge.scd2(store, "s", df, *columns, mark=("feed", k))
        merge.latest(store, "l", df, *columns)
        merge.coalesced(store, "c", df, *columns)
    assert rows_of(merge.scd2_intervals(store, "s", *columns)) == rows_of(scd.scd2(every, *columns))
    assert rows_of(store.read("l")) == rows_of(scd.latest_wins(every, *columns))
    assert rows_of(store.read("c").select("k", "at", "v")) == rows_of(scd.coalesce_latest(every, *columns))
    before = store.head().folders["s"]
    merge.scd2(store, "s", spark.createDataFrame([(3, DAY, "z")], schema), *columns)
    after = store.head().folders["s"]
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1


def test_a_late_observation_cuts_an_interval(spark, tmp_path):
    schema, columns = "k int, at date, v string", (["k"], "at", ["v"])
    store = Store(spark, str(tmp_path), buckets=2)
    for day, v in ((1, "a"), (9, "a"), (5, "b")):
        merge.scd2(store, "s", spark.createDataFrame([(1, dt.date(2020, 1, day), v)], schema), *columns)
    got = [(r.v, r.valid_from.day, r.valid_to and r.valid_to.day) for r in merge.scd2_intervals(store, "s", *columns).orderBy("valid_from").collect()]
    assert got == [("a", 1, 5), ("b", 5, 9), ("a", 9, None)]


def test_revisions_in_any_order(spark, tmp_path):
    r = random.Random(9)
    schema = "fact_id int, company_id int, known_from date, known_to date, available_at date"
    rows = [(k, r.choice([None, 1, 2, 3]), DAY + dt.timedelta(days=r.randrange(30)), DAY + dt.timedelta(days=60) if k % 11 == 0 else None, DAY + dt.timedelta(days=k % 2)) for k in range(80)]
    want = rows_of(pit.close_intervals(spark.createDataFrame(rows, schema), ["company_id"]).select("fact_id", "known_to", "public_time_changed"))
    for seed in range(2):
        store = Store(spark, str(tmp_path / str(seed)), buckets=4)
        for part in parts(rows, 3, seed):
            merge.revisions(store, "facts", spark.createDataFrame(part + part[:3], schema), ["company_id"])
        assert rows_of(store.read("facts").select("fact_id", "known_to", "public_time_changed")) == want


def test_pairs_in_any_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice([None, *"abcdefgh"]), r.choice([None, *"123456789"]), r.randrange(9)) for _ in range(30)] + [("once", "own", 5), ("once", "own", 3)]
    known = {(a, b) for a, b, _ in rows}
    sound = {p for p in known if None not in p}
    bad = lambda p: p not in sound or sum(q[0] == p[0] for q in sound) > 1 or sum(q[1] == p[1] for q in sound) > 1
    want = sorted(str((a, b, min(t for x, y, t in rows if (x, y) == (a, b)), "conflict" if bad((a, b)) else "ledger")) for a, b in known)
    for seed in range(3):
        store = Store(spark, str(tmp_path / str(seed)), buckets=8)
        for part in parts(rows, 3, seed):
            merge.pairs(store, "p", spark.createDataFrame(part, "id string, content_hash string, at int"))
        assert rows_of(merge.pairs_by_kind(store, "p").select("id", "content_hash", "at", "kind")) == want
    before = store.head().folders["p_ids"]
    merge.pairs(store, "p", spark.createDataFrame([("new", "fresh", 1)], "id string, content_hash string, at int"))
    assert sum(before.get(b) != f for b, f in store.head().folders["p_ids"].items()) == 1
    merge.pairs(store, "p", spark.createDataFrame([("newer", "own", 1)], "id string, content_hash string, at int"))
    assert merge.pairs_by_kind(store, "p").where("id = 'once'").first().kind == "conflict"


def test_ledger_appends_once(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path), buckets=4), "id string, content_hash string"
    label = lambda *rows, mark=None: {(r.id, r.content_hash): r.action for r in merge.ledger(store, "l", spark.createDataFrame(list(rows), schema), mark=mark).collect()}
    assert label(("a", "1"), ("b", "2"), ("b", "2"), mark=("f", 0)) == {("a", "1"): "insert", ("b", "2"): "insert"}
    assert merge.ledger(store, "l", spark.createDataFrame([("z", "9")], schema), mark=("f", 0)) is None
    assert label(("a", "1"), ("b", "3"), ("c", "2"), ("d", "4"), ("e", None)) == {("a", "1"): "duplicate", ("b", "3"): "conflict", ("c", "2"): "conflict", ("d", "4"): "insert", ("e", None): "conflict"}
    assert rows_of(store.read("l_ids")) == rows_of(store.read("l_contents").select("id", "content_hash")) == ["('a', '1')", "('b', '2')", "('d', '4')"]
    assert store.read("l_ids").where(F.col("id") == "d").count() == 1
