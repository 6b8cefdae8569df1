"""Bitemporal contracts, slowly changing tables, checks, sources and streams by hand cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofspark.operators import audit, checks, factors, identity, market, pit, scd, transforms, universe, valuation, views
from asofspark.sources import ingest, io
from asofspark.streaming import feeds

D = dt.date
FACT = "fact_id long, company_id int, period_end date, provider_id string, revision int, available_at date, known_from date, known_to date, value double, trust_state string, quality_state string"


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def day(s):
    return F.lit(s).cast("date")


def test_revision_replaces_only_after_availability(spark):
    f = facts(
        spark,
        (1, 1, D(2020, 3, 31), "a", 0, D(2020, 4, 1), D(2020, 4, 1), None, 10.0, "pit_verified", "passed"),
        (2, 1, D(2020, 3, 31), "a", 1, D(2020, 6, 1), D(2020, 6, 1), None, 12.0, "pit_verified", "passed"),
        (3, 1, D(2020, 3, 31), "b", 0, D(2020, 4, 1), D(2020, 4, 1), None, 11.0, "pit_verified", "passed"),
        (4, 2, D(2020, 3, 31), "z", 0, D(2020, 4, 1), D(2020, 4, 1), None, 5.0, "pit_verified", "passed"),
        (5, 3, D(2020, 3, 31), "a", 0, D(2020, 4, 1), D(2020, 4, 1), None, 5.0, "raw", "passed"),
        (6, 4, D(2020, 3, 31), "a", 0, D(2020, 4, 1), D(2020, 4, 1), None, 7.0, "pit_verified", "blocked"),
        (7, 4, D(2020, 3, 31), "b", 0, D(2020, 4, 1), D(2020, 4, 1), None, 7.5, "pit_verified", "passed"),
    )
    before = {r["company_id"]: r for r in pit.select_fact(f, ["a", "b"], day("2020-05-31"), day("2020-12-31")).collect()}
    after = {r["company_id"]: r for r in pit.select_fact(f, ["a", "b"], day("2020-06-01"), day("2020-12-31")).collect()}
    assert before[1]["value"] == 10.0 and after[1]["value"] == 12.0 and after[1]["conflicts"] == ["b"] and after[1]["status"] == "blocked"
    assert before[2]["value"] is None and before[2]["conflicts"] == ["z"] and before[2]["blocks_downstream"]
    assert before[3]["status"] == "unavailable" and before[3]["blocks_downstream"]
    assert before[4]["value"] == 7.5 and before[4]["blocks_downstream"]


def test_system_interval_is_half_open(spark):
    f = facts(spark, (1, 1, D(2020, 3, 31), "a", 0, D(2020, 4, 1), D(2020, 4, 1), D(2020, 5, 1), 1.0, "normalized_current", "passed"))
    assert pit.eligible(f, day("2020-05-01"), day("2020-04-30"), "current").count() == 1
    assert pit.eligible(f, day("2020-05-01"), day("2020-05-01"), "current").count() == 0
    assert pit.eligible(f, day("2020-05-01"), day("2020-04-30")).count() == 0


def test_tied_revisions_conflict_and_corrections_close(spark):
    f = facts(spark, *[(k, 1, D(2020, 3, 31), "a", 2, D(2020, 4, 1 + k // 3), D(2020, 4, k), None, float(k), "pit_verified", "passed") for k in (1, 2, 3)])
    r = pit.select_revision(f).first()
    assert r["conflict"] and r["value"] is None and r["n_winners"] == 3
    closed = {x["fact_id"]: x for x in pit.close_intervals(f, ["company_id", "provider_id", "revision"]).collect()}
    assert closed[1]["known_to"] == D(2020, 4, 2) and closed[3]["known_to"] is None and closed[3]["public_time_changed"] and not closed[2]["public_time_changed"]


def test_scd2_overlaps_and_asof(spark):
    o = spark.createDataFrame([("k", D(2020, 1, 1), "a"), ("k", D(2020, 2, 1), "a"), ("k", D(2020, 3, 1), "b"), ("k", D(2020, 4, 1), "b"), ("k", D(2020, 4, 1), "c")], "k string, d date, v string")
    got = [(r["v"], r["valid_from"], r["valid_to"], r["conflict"]) for r in scd.scd2(o, ["k"], "d", ["v"]).orderBy("valid_from").collect()]
    assert got == [("a", D(2020, 1, 1), D(2020, 3, 1), False), ("b", D(2020, 3, 1), D(2020, 4, 1), False), (None, D(2020, 4, 1), None, True)]
    left = spark.createDataFrame([(1, 5), (1, 3), (1, 0), (2, 9), (None, 4)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "x"), (1, 4, "y"), (1, 4, "w"), (None, 1, "n")], "k int, u int, v string")
    a = {(r["k"], r["t"]): (r["matched_at"], r["v"]) for r in scd.asof(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert a[1, 5] == (4, "w") and a[1, 3] == (3, "x") and a[1, 0] == (None, None) and a[2, 9] == (None, None)
    strict = {r["t"]: r["v"] for r in scd.asof(left.where("k = 1"), right, ["k"], "t", "u", ["v"], strict=True).collect()}
    assert strict == {5: "w", 3: None, 0: None}


def test_market_conflicts_and_limits(spark):
    bars = spark.createDataFrame([(1, D(2020, 1, 1), "a", 5.0), (1, D(2020, 1, 1), "b", 5.0), (1, D(2020, 1, 2), "a", 5.0), (1, D(2020, 1, 2), "b", 6.0)], "listing_id int, session_date date, source_id string, close double")
    got = {r["session_date"]: r for r in market.select_bar(bars, ["close"]).collect()}
    assert got[D(2020, 1, 1)]["source_id"] == "a" and got[D(2020, 1, 2)]["conflict"] and got[D(2020, 1, 2)]["close"] is None
    x = spark.createDataFrame([(1, D(2020, 1, 1), 11.0, 11.0, 11.0), (2, D(2020, 1, 1), 11.0, 10.0, 11.0), (3, D(2020, 1, 1), 9.0, 9.0, 10.0), (4, D(2020, 1, 1), 10.0, 9.0, 11.0), (5, D(2020, 1, 1), 10.0, 9.0, 11.0)], "listing_id int, session_date date, close double, low double, high double")
    lim = spark.createDataFrame([(k, D(2020, 1, 1), 9.0, 11.0) for k in range(1, 5)], "listing_id int, session_date date, lower_limit double, upper_limit double")
    assert [r["limit_status"] for r in market.limit_status(x, lim).orderBy("listing_id").collect()] == ["locked_up", "limit_up", "limit_down", "not_at_limit", "unavailable"]


def test_code_resolution_precedence(spark):
    ask = spark.createDataFrame([("p", c, D(2020, 1, 1)) for c in ("corr", "old", "alias", "hist", "now", "none")], "provider string, code string, as_of date")
    t = lambda rows, cols: spark.createDataFrame(rows, cols)
    span = "code string, listing_id int, valid_from date, valid_to date"
    got = {r["code"]: r for r in identity.resolve(ask, t([("p", "corr", 1, D(2019, 1, 1), None), ("p", "old", 2, D(2018, 1, 1), D(2019, 1, 1))], "provider string, " + span), t([("alias", 3, D(2019, 1, 1), None), ("corr", 9, D(2019, 1, 1), None)], span), t([("hist", 4, D(2019, 1, 1), None), ("old", 2, D(2010, 1, 1), None)], span), t([("now", 5)], "code string, listing_id int")).collect()}
    assert [got[c]["listing_id"] for c in ("corr", "old", "alias", "hist", "now", "none")] == [1, None, 3, 4, 5, None]
    assert got["old"]["how"] == "correction_not_effective" and got["now"]["warning"] and got["none"]["how"] == "not_found"


def test_universe_intervals(spark):
    d = spark.createDataFrame([("u", k, D(2020, 1, s)) for k, ss in {1: (1, 2, 5), 2: (2,), 3: (1, 2, 3, 5)}.items() for s in ss], "universe_id string, listing_id int, session_date date")
    got = sorted((r["listing_id"], r["valid_from"].day, r["valid_to"].day) for r in universe.intervals_from_snapshots(d).collect())
    assert got == [(1, 1, 3), (1, 5, 6), (2, 2, 3), (3, 1, 6)]


def test_checks_linear_rules_and_duplicates(spark):
    f = spark.createDataFrame([(1, "assets", 10.0), (1, "debt", 4.0), (1, "equity", 6.0), (2, "assets", 10.0), (2, "debt", 1.0), (2, "equity", 6.0), (3, "assets", 1.0)], "e int, metric string, value double")
    rules = spark.createDataFrame([("balance", "block", 0.5, [("assets", 1.0), ("debt", -1.0), ("equity", -1.0)])], "rule_id string, severity string, tolerance double, terms array<struct<metric:string,coef:double>>")
    got = {r["e"]: (r["status"], r["blocks"]) for r in checks.linear_rules(f, rules, ["e"]).collect()}
    assert got == {1: ("passed", False), 2: ("failed", True), 3: ("unavailable", True)}
    assert checks.duplicates(f, ["e"]).count() == 2 and checks.orphans(f, f.where("e < 3"), "e").count() == 1


def test_improvement_needs_every_quarter(spark):
    m = spark.createDataFrame([(1, "revenue", q, v) for q, v in [(10, 150.0), (9, 120.0), (6, 100.0), (5, 100.0), (20, 1.0)]], "entity_id int, metric string, q int, value double")
    got = {r["q"]: r for r in factors.improvement(m).collect()}
    assert got[10]["trend"] == pytest.approx(0.5) and got[10]["value"] == pytest.approx(0.3)
    assert got[20]["unavailable_reason"] == "missing_quarter"
    assert factors.improvement_window(m, ["revenue"]).first()["q"] == 10


def test_valuation_corners(spark):
    cols = "template string, price double, base_lo double, base_hi double, book_lo double, book_hi double, roe_lo double, roe_hi double, growth_lo double, growth_hi double, rate_lo double, rate_hi double"
    x = spark.createDataFrame([("general", 100.0, 4.0, 6.0, None, None, None, None, 0.01, 0.03, 0.08, 0.1), ("bank", 10.0, None, None, 9.0, 11.0, 0.1, 0.12, 0.01, 0.02, 0.08, 0.1), ("general", 10.0, 1.0, 1.0, None, None, None, None, 0.01, 0.09, 0.08, 0.1)], cols)
    got = valuation.anchor(x).collect()
    assert got[0]["value_lo"] == pytest.approx(4 * 1.01 / 0.09) and got[0]["value_hi"] == pytest.approx(6 * 1.03 / 0.05)
    corners = [b * (e - g) / (r - g) for b in (9, 11) for e in (0.1, 0.12) for g in (0.01, 0.02) for r in (0.08, 0.1)]
    assert got[1]["value_lo"] == pytest.approx(min(corners)) and got[1]["value_hi"] == pytest.approx(max(corners))
    assert got[2]["anchor_reason"] == "rate_not_above_growth"
    gap = valuation.gap(valuation.implied(x)).first()
    assert gap["gap_lo"] == pytest.approx(0.01 - (100 * 0.1 - 4) / 104)


def test_views_and_maturity(spark):
    c = spark.createDataFrame([(1, k, v) for k, v in zip(views.COMPONENTS, [0.1, 0.2, None, 0.05], strict=True)] + [(2, "quality", 0.1)], "view_id int, component string, contribution double")
    got = {r["view_id"]: r for r in views.compile_views(c).collect()}
    assert got[1]["value"] == pytest.approx(0.35) and got[2]["unavailable_reason"] == "component_set_differs"
    p = spark.createDataFrame([(7, D(2020, 1, k), 10.0 + k) for k in range(1, 8)], "security_id int, session_date date, close double")
    v = spark.createDataFrame([(1, 7, D(2020, 1, 2)), (2, 7, D(2020, 1, 6)), (3, 8, D(2020, 1, 2)), (4, 7, D(2020, 1, 1))], "view_id int, security_id int, decision_date date")
    o = spark.createDataFrame([(4,)], "view_id int")
    m = {r["view_id"]: r for r in views.mature(v, p, o, 3, "2020-01-31").collect()}
    assert m[1]["realized_return"] == pytest.approx(15 / 12 - 1) and m[2]["reason"] == "horizon_not_reached" and m[3]["reason"] == "price_missing" and 4 not in m


def test_readiness_and_ledger(spark):
    need = spark.createDataFrame([("s", "bars", 1, 0.5, D(2020, 1, 1), D(2020, 2, 1)), ("s", "facts", 1, 0.5, D(2020, 1, 1), D(2020, 2, 1))], "study_id string, role string, min_trust int, min_coverage double, window_from date, window_to date")
    have = spark.createDataFrame([("s", "bars", 0, False, 0.9, D(2020, 1, 5), D(2020, 3, 1), True)], "study_id string, role string, trust int, quality_failed boolean, coverage double, first_date date, last_date date, lineage_ok boolean")
    assert audit.readiness(need, have).first()["blockers"] == ["missing:facts", "trust:bars", "window:bars"]
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("d", "1"), ("e", "5"), ("e", "6"), ("c", "4")], "id string, content_hash string")
    got = {(r["id"], r["content_hash"]): r["action"] for r in ingest.ledger_append(old, new).collect()}
    assert got == {("a", "1"): "conflict", ("b", "3"): "conflict", ("c", "4"): "insert", ("d", "1"): "conflict", ("e", "5"): "conflict", ("e", "6"): "conflict"} or got["c", "4"] == "insert"
    assert got["d", "1"] == "conflict" and got["b", "3"] == "conflict"


def bars_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "listing_id long, session_date date, source_id string, close double, volume long, dataset_version_id string, exchange string")


def test_parquet_round_trip_is_immutable_and_pruned(spark, tmp_path):
    root = str(tmp_path / "bars")
    df = bars_frame(spark, *[(k, D(2019 + k % 3, 5, 1 + k), "s", 1.0 + k, k, "v1", "E" if k % 2 else "O") for k in range(9)])
    assert io.read_bars(spark, root, "v1", "2019-01-01", "2019-12-31").count() == 0
    assert io.ensure_bars(df, root) == "written" and io.ensure_bars(df.repartition(3), root) == "unchanged"
    with pytest.raises(io.ImmutableTargetError):
        io.write_bars(df, root)
    with pytest.raises(io.ImmutableTargetError):
        io.ensure_bars(df.withColumn("close", F.col("close") + 1), root)
    with pytest.raises(io.ImmutableTargetError):
        io.ensure_bars(df.unionByName(df.withColumn("dataset_version_id", F.lit("v2"))), root)
    with pytest.raises(ValueError):
        io.read_bars(spark, root, "v1", "2020-01-01", "2019-01-01")
    before = sorted(x.name for x in (tmp_path / "bars").iterdir())
    with pytest.raises(io.ImmutableTargetError):  # a new version beside one that is there, or beside rows without one
        io.write_bars(df.unionByName(df.withColumn("dataset_version_id", F.lit("v3"))), root)
    with pytest.raises(io.ImmutableTargetError):
        io.write_bars(df.withColumn("dataset_version_id", F.when(F.col("listing_id") > 3, "v4")), root)
    assert sorted(x.name for x in (tmp_path / "bars").iterdir()) == before and len(before) == 2  # the commits and one folder
    got = io.read_bars(spark, root, "v1", "2020-01-01", "2020-12-31")
    assert got.count() == 3 and "PartitionFilters: [" in got._jdf.queryExecution().toString()
    assert [r["listing_id"] for r in io.read_bars(spark, root, "v1", "2019-05-01", "2021-06-01", 4).collect()] == [4]
    f = spark.createDataFrame([(1, D(2020, 1, 1), "s", 0.5, "v1")], "listing_id long, session_date date, source_id string, multiplier double, dataset_version_id string")
    io.write_factors(f, str(tmp_path / "f"))
    assert io.read_factors(spark, str(tmp_path / "f"), "v1", "2020-01-01", "2020-01-01", 1).first()["multiplier"] == 0.5


def test_feature_definition_checks_its_inputs(spark):
    rows = [("a", "x", 4.0, "currency", "CNY", 1), ("a", "y", 2.0, "currency", "CNY", 1), ("b", "x", 4.0, "ratio", "CNY", 1), ("b", "y", 2.0, "currency", "CNY", 1), ("c", "x", 4.0, "currency", "USD", 1), ("c", "y", 2.0, "currency", "CNY", 1)]
    rows += [("d", "x", 4.0, "currency", "CNY", 1), ("d", "y", 2.0, "currency", "CNY", 2), ("e", "x", 4.0, "currency", "CNY", 1), ("f", "z", 1.0, "count", None, 1), ("g", "x", 1.0, "currency", "CNY", 1), ("g", "y", 0.0, "currency", "CNY", 1)]
    facts_of = spark.createDataFrame(rows, "id string, metric string, value double, unit string, currency string, period int")
    inputs = {"x": ("currency", "CNY"), "y": ("currency", "CNY")}
    got = {r["id"]: r for r in transforms.feature(facts_of, ["id"], inputs, "try_divide(x, y)").collect()}
    assert got["a"]["value"] == 2.0 and {k: got[k]["unavailable_reason"] for k in "bcdefg"} == {"b": "unit_mismatch", "c": "currency_mismatch", "d": "period_mismatch", "e": "missing_input", "f": "missing_input", "g": "undefined"}
    assert {r["id"] for r in transforms.feature(facts_of, ["id"], inputs, "try_divide(x, y)", "reject").where("status = 'rejected'").collect()} == {"e", "f"}


def test_promotion_needs_every_check_once_and_history(spark):
    rows = [(k, c, "pass") for k in (1, 2, 3, 4) for c in audit.VALIDATION_CHECKS if (k, c) != (2, "fdr")] + [(3, "ic", "pass")]
    context = spark.createDataFrame([(k, "strict_historical" if k < 4 else "current", "research", "pit_verified") for k in (1, 2, 3, 4)], "report_id int, data_mode string, stage string, trust_state string")
    got = {r["report_id"]: r for r in audit.promotion_gate(spark.createDataFrame(rows, "report_id int, check_name string, outcome string"), context).collect()}
    assert [got[k]["may_promote"] for k in (1, 2, 3, 4)] == [True, False, False, False] and got[2]["missing"] == ["fdr"] and got[3]["n_repeated"] == 1


def test_share_capital_and_outcome_reasons(spark):
    raw = spark.createDataFrame([("1", "2020-01-02", "1,000.5", "3", "--"), ("1", "2020-01-02", "1,000.5", "3", "--"), ("1", "-", "5", None, None), ("1", "2020-01-03", None, "1", "1")], "code string, change_date string, total string, circulating string, restricted string")
    got = ingest.share_capital(raw).collect()
    assert [(r["total_shares"], r["circulating_shares"], r["restricted_shares"]) for r in got] == [(10_005_000, 30_000, None)] and len(got[0]["record_id"]) == 64
    p = spark.createDataFrame([(s, D(2020, 1, k), 10.0, None if (s, k) == (2, 5) else 0.5 if k < 4 else 1.0, None if s == 3 else "s") for s in (1, 2, 3) for k in range(1, 8)], "security_id int, session_date date, close double, multiplier double, source_id string")
    v = spark.createDataFrame([(k, k, D(2020, 1, 2)) for k in (1, 2, 3)], "view_id int, security_id int, decision_date date")
    got = {r["view_id"]: r for r in views.mature(v, p, v.select("view_id").limit(0), 3, "2020-01-31").collect()}
    assert got[1]["realized_return"] == pytest.approx(1.0) and got[2]["reason"] == "actions_missing" and got[3]["reason"] == "source_missing"


def test_streams(spark, tmp_path):
    schema = "id string, content_hash string, observed_at timestamp"
    src, led = str(tmp_path / "in"), str(tmp_path / "ledger")
    at = dt.datetime(2020, 1, 1)
    spark.createDataFrame([("a", "1", at), ("a", "1", at), ("b", "2", at), ("d", None, at)], schema).write.mode("append").parquet(src)
    for more in ([], [("b", "9", at), ("c", "3", at - dt.timedelta(days=900)), ("a", "1", at - dt.timedelta(days=900))]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(src)
        feeds.append_stream(spark.readStream.schema(schema).parquet(src), led, str(tmp_path / "cp"), buckets=4).awaitTermination(120)
    kinds = {(r["id"], r["content_hash"]): (r["kind"], r["observed_at"]) for r in feeds.appended(spark, led).collect()}
    assert kinds == {("a", "1"): ("ledger", at - dt.timedelta(days=900)), ("c", "3"): ("ledger", at - dt.timedelta(days=900)), ("b", "2"): ("conflict", at), ("b", "9"): ("conflict", at), ("d", None): ("conflict", at)}

    log, fsrc = str(tmp_path / "log"), str(tmp_path / "facts")
    for k in (1, 3, 2, 5):
        facts(spark, (k, 1, D(2020, 3, 31), "a", 0, D(2020, 4, 1), D(2020, 4, k), None, float(k), "pit_verified", "passed")).write.mode("append").parquet(fsrc)
        feeds.revision_stream(spark.readStream.schema(FACT).parquet(fsrc), log, str(tmp_path / "cp2"), ["company_id", "provider_id"], buckets=4).awaitTermination(120)
    now = {r["fact_id"]: r["known_to"] for r in feeds.current_intervals(spark, log).collect()}
    assert now == {1: D(2020, 4, 2), 2: D(2020, 4, 3), 3: D(2020, 4, 5), 5: None}  # 2 comes after 3 had closed 1

    vs, ps = str(tmp_path / "v"), str(tmp_path / "p")
    day = dt.timedelta(days=1)
    spark.createDataFrame([("v1", 7, at, 10.0), ("v2", 7, at + 30 * day, 10.0), ("v3", 8, at, 10.0)], "view_id string, security_id int, decision_at timestamp, price double").write.parquet(vs)
    spark.createDataFrame([(7, at + 23 * day, 12.0), (7, at + 24 * day, 13.0), (7, at + 5 * day, 99.0)], "p_security_id int, priced_at timestamp, close double").write.parquet(ps)
    def mature():
        views = spark.readStream.schema("view_id string, security_id int, decision_at timestamp, price double").parquet(vs)
        prices = spark.readStream.schema("p_security_id int, priced_at timestamp, close double").parquet(ps)
        feeds.maturity_stream(views, prices, str(tmp_path / "m"), str(tmp_path / "cp3"), 20).awaitTermination(120)
        return {r["view_id"]: (r["status"], r["realized_return"] and round(r["realized_return"], 6)) for r in feeds.maturity(spark, str(tmp_path / "m")).collect()}

    assert mature() == {"v1": ("mature", 0.2), "v2": ("pending", None), "v3": ("pending", None)}  # no price on the day itself
    spark.createDataFrame([(7, at + 50 * day, 9.0), (8, at + 19 * day, 1.0)], "p_security_id int, priced_at timestamp, close double").write.mode("append").parquet(ps)
    assert mature() == {"v1": ("mature", 0.2), "v2": ("mature", -0.1), "v3": ("pending", None)}
