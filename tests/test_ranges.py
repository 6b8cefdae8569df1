"""Range joins, lineage closures and identities as of a day, against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofspark.operators import audit, identity, scd
from asofspark.sources import ingest

DAY = dt.date(2019, 12, 20)


def days(r, most=400):
    return DAY + dt.timedelta(days=r.randrange(most))


@pytest.mark.parametrize("keys, inclusive, how", [(["k"], False, "left"), (["k"], True, "inner"), ([], False, "inner")])
def test_slab_join_meets_every_pair_once(spark, keys, inclusive, how):
    r = random.Random(6)
    points = [(k, r.choice([None, 1, 2]), r.choice([None, days(r), days(r), days(r)])) for k in range(60)] + [(60, 1, DAY), (60, 1, DAY)]
    intervals = [(k, r.choice([None, 1, 2]), r.choice([None, days(r), days(r)]), r.choice([None, days(r, 500)])) for k in range(40)] + [(40, 1, DAY, DAY)]
    within = lambda d, lo, hi: d and lo and lo <= d and (hi is None or d < hi or inclusive and d == hi)
    want = []
    for p, k, d in points:
        hits = [i for i, j, lo, hi in intervals if (not keys or k is not None and k == j) and within(d, lo, hi)]
        want += [(p, i) for i in hits or ([None] if how == "left" else [])]
    left = spark.createDataFrame(points, "p int, k int, d date")
    right = spark.createDataFrame(intervals, "i int, k int, valid_from date, valid_to date")
    got = scd.slab_join(left, right if keys else right.drop("k"), keys, "d", how=how, days=16, inclusive=inclusive)
    assert sorted(map(str, got.select("p", "i").collect())) == sorted(f"Row(p={p}, i={i})" for p, i in want)
    assert got.columns == ["p", "k", "d", "i", "valid_from", "valid_to"]


def test_visible_names_go_before_newer_ended_ones(spark):
    r = random.Random(2)
    names = [(r.randrange(4), "name", f"n{k}", days(r, 90), r.choice([None, days(r, 120)])) for k in range(30)]
    points = [(k, days(r, 130)) for k in range(5) for _ in range(12)]
    want = {}
    for k, d in set(points):
        own = [(lo <= d and (hi is None or d < hi), lo, n) for j, _, n, lo, hi in names if j == k and (lo < d or lo <= d and (hi is None or d < hi))]
        want[k, d] = max(own)[2] if own else None
    got = identity.identifier_at(spark.createDataFrame(points, "listing_id int, as_of date"), spark.createDataFrame(names, "listing_id int, kind string, identifier string, valid_from date, valid_to date"), "name", "name")
    assert {(x.listing_id, x.as_of): x.name for x in got.collect()} == want


def ancestors(edges, start):
    depth, front, n = {}, {start}, 0
    while front:
        n += 1
        front = {u for u, d in edges if d in front} - set(depth)
        depth |= dict.fromkeys(front, n)
    return depth


def test_closure_of_lineage_with_cycles(spark):
    r = random.Random(3)
    edges = [(f"d{r.randrange(30)}", f"d{r.randrange(30)}") for _ in range(34)] + [(f"c{k}", f"c{(k + 1) % 11}") for k in range(11)] + [(f"p{k}", f"p{k + 1}") for k in range(13)] + [("self", "self"), (None, "d1"), ("d1", None)]
    ids = ["d1", "d2", "d3", "c4", "p13", "self", "unknown"]
    got = audit.upstream_closure(spark.createDataFrame(edges, "upstream_id string, downstream_id string"), spark.createDataFrame([(i,) for i in [*ids, "d1", None]], "id string")).collect()
    sound = [e for e in edges if None not in e]
    assert sorted((x.id, x.ancestor_id, x.depth, x.cyclic) for x in got) == sorted((i, a, n, a == i) for i in ids for a, n in ancestors(sound, i).items())


def test_evidence_is_closed_with_all_that_it_rests_on(spark):
    edges = spark.createDataFrame([("raw", "bars"), ("bars", "factor"), ("other", "factor")], "upstream_id string, downstream_id string")
    used = spark.createDataFrame([("x", "factor"), ("y", "bars"), ("z", "loose")], "artifact_id string, dataset_id string")
    approved = spark.createDataFrame([("x", "factor"), ("x", "bars"), ("x", "raw"), ("y", "bars"), ("y", "raw"), ("z", "loose"), ("z", "more")], "artifact_id string, dataset_id string")
    got = {x.artifact_id: (x.unapproved, x.closed) for x in audit.evidence_closure(used, approved, edges, "artifact_id").collect()}
    assert got == {"x": (["other"], False), "y": ([], True), "z": ([], True)}


def test_observations_take_the_identity_of_their_local_day(spark):
    at = dt.datetime(2024, 1, 9, 17, 0)  # the tenth in Shanghai
    rows = [("u", "a", at, "m1"), ("u", "a", at - dt.timedelta(hours=2), "m2"), ("u", "b", at, "m3"), ("u", "c", at, "m4"), ("u", "a", None, "m5")]
    mapped = spark.createDataFrame(rows, "unit_id string, code string, retrieved_at timestamp, metric string").withColumns({"status": F.lit("mapped"), "period_end": F.lit("2023").cast("string"), "value": F.lit(1.0), "provider_id": F.lit("p")})
    tenth = dt.date(2024, 1, 10)
    known = [("a", 1, DAY, tenth), ("a", 2, tenth, None), ("b", 3, DAY, None), ("b", 4, DAY, None), ("b", 4, DAY, None), ("c", 5, dt.date(2024, 1, 11), None)]
    obs, receipts = ingest.observations(mapped, spark.createDataFrame(known, "code string, company_id int, valid_from date, valid_to date"), spark.createDataFrame([("u",), ("v",)], "unit_id string"))
    got = {x.metric: (x.company_id, x.identity_status) for x in obs.collect()}
    assert got == {"m1": (2, "resolved"), "m2": (1, "resolved"), "m3": (None, "ambiguous"), "m4": (None, "not_found"), "m5": (None, "not_found")}
    assert {x.unit_id: x.status for x in receipts.collect()} == {"u": "succeeded", "v": "empty"}
