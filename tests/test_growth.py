"""What would grow faster than its input: the plans, and the same results on odd rows."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from asofspark.operators import audit, identity, market, pit
from asofspark.plans import core
from asofspark.sources import merge
from asofspark.sources.store import Store
from asofspark.streaming import feeds
from test_maturing import Handle, Map
from test_ranges import ancestors


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def day(n):
    return None if n is None else dt.date(2000, 1, 1) + dt.timedelta(n)


def test_bars_without_a_limit_are_found_without_a_loop_over_all_pairs(spark):
    bars = spark.createDataFrame([(1, day(0), 10, 5.0, 4.0, 6.0), (1, day(1), 10, 5.0, 4.0, 6.0), (2, day(0), 6, 5.0, 4.0, 6.0), (2, day(1), 7, 5.0, 4.0, 6.0), (None, day(1), 5, 5.0, 4.0, 6.0)], "listing_id int, session_date date, volume long, close double, low double, high double")
    limits = spark.createDataFrame([(1, day(1), 2.0, 9.0), (2, day(1), 2.0, 9.0)], "listing_id int, session_date date, lower_limit double, upper_limit double")
    got = market.limit_status(core.limited(bars, limits), limits)
    assert sorted((r[0], r[1], r["limit_status"]) for r in got.collect()) == [(1, day(0), "unavailable"), (1, day(1), "locked_up"), (2, day(0), "unavailable"), (2, day(1), "not_at_limit")]
    assert "NestedLoop" not in plan(got)


def test_a_code_of_many_listings_is_one_sorted_stream(spark):
    r = random.Random(3)
    listings = [(k, "EO"[k % 2]) for k in range(40)]
    maybe = lambda n: None if r.random() < 0.1 else r.randrange(n)
    history = [(k, "code", None if r.random() < 0.05 else f"c{r.randrange(12)}", day(maybe(30)), day(maybe(40))) for k in range(42) for _ in range(6)]
    asked = [(r.choice(["E", "O", None]), r.choice([f"c{k}" for k in range(14)] + [None]), day(maybe(40))) for _ in range(500)]
    on = dict(listings)
    want = set()
    for e, c, d in asked:
        held = {k for k, _, i, a, b in history if None not in (e, c, d, a) and on.get(k) == e and i == c and a <= d and (b is None or d < b)}
        want.add((e, c, d, min(held) if len(held) == 1 else None, "not_found" if not held else "resolved" if len(held) == 1 else "ambiguous"))
    requests = spark.createDataFrame(asked, "exchange string, code string, as_of date")
    got = identity.resolve_listing(requests, spark.createDataFrame(listings, "listing_id int, exchange string"), spark.createDataFrame(history, "listing_id int, kind string, identifier string, valid_from date, valid_to date"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {s for *_, s in want} == {"not_found", "resolved", "ambiguous"}
    assert not any("as_of" in line for line in plan(got).splitlines() if "Join " in line)  # requests with all that have the code


def test_checks_are_counted_before_the_shuffle(spark):
    r = random.Random(5)
    names = [*audit.VALIDATION_CHECKS, "more", "other", None]
    rows = [(k % 70 or None, names[r.randrange(len(names))] if k % 70 > 20 else names[k // 70 % 12], r.choice(["pass", "pass", "fail", None]) if k % 70 > 10 else "pass") for k in range(840)]
    got = audit.promotion_gate(spark.createDataFrame(rows, "report_id int, check_name string, outcome string"))
    want = {}
    for k in {k for k, _, _ in rows}:
        own = [(n, o) for i, n, o in rows if i == k]
        named = [n for n, _ in own if n is not None]
        missing, failed, twice = sorted(set(audit.VALIDATION_CHECKS) - set(named)), sum(o == "fail" for _, o in own), len(named) - len(set(named))
        firm = all((c, "pass") in own for c in audit.NON_WAIVABLE_CHECKS)
        want[k] = (missing, failed, twice, not missing and not failed and not twice and firm)
    assert {r["report_id"]: (r["missing"], r["n_failed"], r["n_repeated"], r["may_promote"]) for r in got.collect()} == want
    assert {w[3] for w in want.values()} == {True, False}
    assert "ObjectHashAggregate" not in plan(got)  # sets of names, sorted and shuffled a report


def test_a_snapshot_of_all_days_looks_a_listing_up_once_a_stretch(spark):
    r = random.Random(4)
    maybe = lambda n: None if r.random() < 0.3 else r.randrange(n)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    listed = [(k, k % 5, "E", day(r.randrange(20)), day(maybe(40))) for k in range(9)]
    history = [(k, kind, f"{kind}{r.randrange(50)}", day(r.randrange(40)), day(maybe(40))) for k in range(9) for kind in ("code", "name") for _ in range(3)]
    industries = [(k, "t", f"I{r.randrange(4)}", day(r.randrange(40)), day(maybe(40))) for k in range(5) for _ in range(3)]
    states = [(k, day(a), day(a + 9), f"s{a}", None) for k in range(9) for a in r.sample(range(40), 2)]
    dates = [day(r.randrange(60)) for _ in range(50)]
    now = lambda d, a, b: a <= d and (b is None or d < b)
    want = set()
    for d in dates:
        for k, s, e, a, b in listed:
            if not (a <= d and (b is None or d <= b)):
                continue
            ids = []
            for kind in ("code", "name"):
                own = [(f, i, t) for x, q, i, f, t in history if x == k and q == kind]
                seen, past = [(f, i) for f, i, t in own if now(d, f, t)], [(f, i) for f, i, _ in own if f < d]
                ids.append(max(seen or past or [(None, None)])[1])
            state = max([(f, g) for x, f, t, g, _ in states if x == k and now(d, f, t)], default=(None, None))[1]
            want.add((d, k, s, 1, "C", e, *ids, tuple(sorted({i for x, _, i, f, t in industries if x == s and now(d, f, t)})), state, None))
    spans = "valid_from date, valid_to date"
    args = make([(1, "C")], "company_id int, company_name string"), make([(k, 1) for k in range(5)], "security_id int, company_id int"), make(listed, "listing_id int, security_id int, exchange string, listed_on date, delisted_on date")
    args += make(history, f"listing_id int, kind string, identifier string, {spans}"), make(industries, f"security_id int, taxonomy string, industry_code string, {spans}"), make([(d,) for d in dates], "as_of date")
    got = identity.snapshot(*args, make(states, f"listing_id int, {spans}, listing_state string, special_treatment string"))
    assert sorted([tuple(tuple(x) if isinstance(x, list) else x for x in row) for row in got.collect()], key=str) == sorted(want, key=str)
    lines = plan(got).split("Initial Plan")[0].splitlines()
    assert next(k for k, line in enumerate(lines) if "Generate explode" in line) < min(k for k, line in enumerate(lines) if "Exchange" in line)  # days come last


def test_a_view_is_told_with_its_security_and_few_calls_of_the_state():
    class Counted(Map):
        calls = 0

        def updateValue(self, k, v):
            type(self).calls += 1
            self[k] = v

        def iterator(self):
            type(self).calls += 1
            return iter(self.items())

        def getValue(self, k):
            type(self).calls += 1
            return self[k]

        def keys(self):
            type(self).calls += 1
            return super().keys()

    handle, p = Handle(), feeds.MaturingGroup(2)
    handle.maps = {"views": Counted(), "prices": Counted()}
    p.init(handle)
    events = [(f"={s}", f"{s}v{k}", k * feeds.DAY, 10.0, None) for k in range(20) for s in "ab"] + [(f"={s}", None, k * feeds.DAY, None, 5.0) for k in range(20) for s in "ab"]
    rows = [r for df in p.handleInputRows((7,), iter([pd.DataFrame(events, columns=["security", "view", "us", "price", "close"])]), None) for r in df.itertuples(index=False)]
    assert all(r.security == f"={r.view[0]}" for r in rows) and len(rows) == 76
    assert Counted.calls <= 4  # each map is read once, and each of its slabs that changes written once


def test_maturity_names_the_security(spark, tmp_path):
    told = [("1", 10.0, None, None, "=a"), ("1", 10.0, 5, 11.0, "=a"), ("2", 10.0, None, None, "")]
    spark.createDataFrame(told, feeds.TOLD).write.parquet(f"{tmp_path}/told")
    got = {r["view_id"]: (r["security_id"], r["status"]) for r in feeds.maturity(spark, str(tmp_path)).collect()}
    assert got == {"1": ("a", "mature"), "2": (None, "pending")}


def test_revisions_meet_after_one_shuffle_by_their_keys(spark):
    rows = [(k % 50, k % 3, day(k % 20), day(1), None) for k in range(400)] * 2
    df = spark.createDataFrame(rows, "fact_id int, company_id int, known_from date, available_at date, known_to date")
    got = pit.close_intervals(merge.distinct_by(df, ["company_id"], 3), ["company_id"])
    assert got.count() == len(set(rows))
    lines = [line.split("(")[0].strip(" +-:*") for line in plan(got).splitlines()]
    assert sum(line.startswith("Exchange") for line in lines) == 1
    at = next(k for k, line in enumerate(lines) if line.startswith("Exchange"))
    assert not any("Aggregate" in line for line in plan(got).splitlines()[at:])


def test_later_rounds_of_a_closure_read_fewer_edges(spark, monkeypatch):
    read, rest = [], audit.rested

    def counted(df, label):
        out = rest(df, label)
        if label == "edges":
            read.append(out.count())
        return out

    monkeypatch.setattr(audit, "rested", counted)
    monkeypatch.setattr(audit, "FEW_EDGES", 20)
    edges = [(f"d{k}", f"d{2 * k + 1}") for k in range(200)] * 2 + [("d9", "d8"), ("d8", "d9"), ("d3", "d399"), ("d0", "d0"), (None, "d1"), ("d1", None)]
    ids = [f"d{k}" for k in range(0, 400, 3)]
    got = audit.upstream_closure(spark.createDataFrame(edges, "upstream_id string, downstream_id string"), spark.createDataFrame([(i,) for i in ids], "id string")).collect()
    sound = [e for e in edges if None not in e]
    assert sorted((x.id, x.ancestor_id, x.depth, x.cyclic) for x in got) == sorted((i, a, n, a == i) for i in ids for a, n in ancestors(sound, i).items())
    assert len(read) > 3 and all(a > b for a, b in zip(read, read[1:])) and read[-1] <= 20


def test_uses_and_approvals_meet_without_a_join_of_sets(spark):
    used = [("x", "a"), ("x", "b"), ("x", "a"), ("y", "c"), (None, "a"), ("w", None), ("x", None)]
    approved = [("x", "a"), ("x", "a"), ("x", "z"), ("y", "c"), (None, "a"), ("v", "a")]
    got = audit.lineage_closure(*(spark.createDataFrame(rows, "artifact_id string, dataset_id string") for rows in (used, approved)), "artifact_id")
    assert {x.artifact_id: (x.unapproved, x.closed) for x in got.collect()} == {"x": (["b"], False), "y": ([], True), None: (["a"], False), "w": ([], True)}
    assert "Join" not in plan(got)


def test_a_ledger_makes_its_new_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(k):
        made.add(1)
        return f"h{k}"

    store = Store(spark, str(tmp_path), buckets=4)
    for at in (0, 50):
        labels = merge.ledger(store, "l", spark.range(at, at + 100).select(F.col("id").cast("string").alias("id"), content("id").alias("content_hash")))
    assert {r["action"]: r["count"] for r in labels.groupBy("action").count().collect()} == {"duplicate": 50, "insert": 50}
    assert made.value == 200
