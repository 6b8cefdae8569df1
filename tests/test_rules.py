"""Rules of evidence, plans and health by hand cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from asofspark.operators import audit, pit, transforms, valuation
from asofspark.sources import ingest

D = dt.date
FACT = "fact_id long, company_id int, period_end date, provider_id string, revision int, available_at date, known_from date, known_to date, value double, unit string, currency string, trust_state string, quality_state string"


def fact(k, provider, value, unit="one", currency="CNY", company=1, quality="passed", known_to=None):
    return (k, company, D(2020, 3, 31), provider, 0, D(2020, 4, 1), D(2020, 4, 1), known_to, value, unit, currency, "pit_verified", quality)


def test_unit_and_currency_are_part_of_what_a_fact_says(spark):
    f = spark.createDataFrame([fact(1, "a", 5.0), fact(2, "b", 5.0), fact(3, "c", 5.0, unit="thousand"), fact(4, "d", 5.0, currency=None), fact(5, "a", 7.0, company=2), fact(6, "b", 7.0, company=2), fact(7, "b", 9.0, company=2, quality="blocked", known_to=D(2020, 5, 1))], FACT)
    day = F.lit("2020-06-01").cast("date")
    got = {r.company_id: r for r in pit.select_fact(f, ["a"], day, day).collect()}
    assert got[1].conflicts == ["c", "d"] and got[1].status == "blocked" and got[2].status == "selected" and got[2].value == 7.0
    unmapped = spark.createDataFrame([(9, "a", "x", "pending"), (8, "a", "y", "resolved")], "field_id long, provider_id string, source_field string, status string")
    entries = {(r.mismatch_type, r.company_id): (r.provider_ids, r.related_ids) for r in pit.mismatch_entries(f.unionByName(spark.createDataFrame([fact(10, "a", 1.0, company=3, quality="blocked")], FACT)), unmapped).collect()}
    assert entries == {("provider_value_conflict", 1): (["a", "b", "c", "d"], ["1", "2", "3", "4"]), ("quality_block", 3): (["a"], ["10"]), ("unmapped_field", None): (["a"], ["9"])}


def test_rows_outside_the_asked_period_are_skipped_and_counted(spark):
    wide = spark.createDataFrame([("a", 1, 1.0, None, True), ("a", 1, 2.0, 3.0, False), ("b", 1, None, float("nan"), True), ("c", 1, 4.0, 4.0, True), ("c", 1, 5.0, 5.0, True), ("d", 1, 6.0, 6.0, None)], "code string, p int, revenue double, cost double, asked boolean")
    long = ingest.financial_long(wide, ["code", "p"], ["revenue", "cost"], F.col("asked"))
    assert [(r.code, r.field, r.raw_value) for r in long.collect()] == [("a", "revenue", 1.0)]
    assert tuple(ingest.financial_counters(wide, ["p"], ["code", "p"], ["revenue", "cost"], F.col("asked")).first()) == (1, 4, 2, 2, 2)


def test_money_needs_a_currency(spark):
    rows = spark.createDataFrame([(1, "p", "x", 2.0, "currency", "CNY"), (2, "p", "x", 2.0, "currency", None), (3, "p", "y", 2.0, "shares", "CNY"), (4, "p", "y", 2.0, "shares", None), (5, "p", "y", 2.0, "currency", None)], "k int, provider_id string, field string, raw_value double, unit string, currency string")
    mappings = spark.createDataFrame([("p", "x", "revenue", 10.0, "both"), ("p", "y", "held", 1.0, "both")], "provider_id string, field string, metric string, scale double, scope string")
    metrics = spark.createDataFrame([("revenue", "currency"), ("held", "shares")], "metric string, unit string")
    got = {r.k: (r.status, r.value) for r in ingest.map_fields(rows, mappings, metrics, "current").collect()}
    assert got == {1: ("mapped", 20.0), 2: ("currency_missing", None), 3: ("currency_unexpected", None), 4: ("mapped", 2.0), 5: ("unit_mismatch", None)}


def test_availability_policy_and_enforcement(spark):
    need = spark.createDataFrame([(s, "bars", 1, 0.5, D(2020, 1, 1), D(2020, 2, 1), "close") for s in "abcd"], "study_id string, role string, min_trust int, min_coverage double, window_from date, window_to date, availability_policy string")
    have = spark.createDataFrame([("a", "close", True, False), ("b", "announcement", True, True), ("c", None, False, False)], "study_id string, availability_policy string, availability_enforced boolean, quality_warned boolean")
    have = have.selectExpr("study_id", "'bars' as role", "2 as trust", "false as quality_failed", "0.9D as coverage", "date '2019-01-01' as first_date", "date '2021-01-01' as last_date", "true as lineage_ok", "availability_policy", "availability_enforced", "quality_warned")
    got = {r.study_id: (r.blockers, r.warnings, r.permitted) for r in audit.readiness(need, have).collect()}
    assert got == {"a": ([], [], True), "b": (["availability_policy:bars"], ["quality_warned:bars"], False), "c": (["availability_enforcement:bars", "availability_policy:bars"], [], False), "d": (["missing:bars"], [], False)}


def test_desk_sections(spark):
    at = dt.datetime(2020, 1, 1)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    jobs = frame([("j1", "failed", None, at), ("j2", "succeeded", ["timeout"], at + dt.timedelta(1)), ("j3", "succeeded", [], at + dt.timedelta(9))], "job_id string, status string, failure_reasons array<string>, updated_at timestamp")
    reviews, timing = frame([], "review_id int, decided_at timestamp"), frame([(1, D(2020, 1, 3), None), (2, D(2020, 1, 2), 0.5)], "forecast_id int, effective_session date, passive_exposure double")
    datasets, reports = frame([("d1", at), ("d2", at)], "dataset_id string, created_at timestamp"), frame([("d1", 0), ("d2", 0)], "dataset_id string, checks_failed int")
    got = {r.section: (r.status, r.n_rows, r.n_flagged, r.newest) for r in audit.desk_sections(datasets, reports, jobs, reviews, timing).collect()}
    assert got == {"data_health": ("ready", 2, 0, at), "active_failures": ("partial", 2, 2, at + dt.timedelta(1)), "pending_tasks": ("empty", 0, 0, None), "timing_shadow": ("partial", 2, 1, dt.datetime(2020, 1, 3))}
    late = audit.desk_sections(datasets, frame([("d1", 3)], "dataset_id string, checks_failed int"), jobs, reviews, timing).where("section = 'data_health'").first()
    assert (late.status, late.n_flagged) == ("partial", 2)
    assert audit.desk_sections(datasets.limit(0), reports, jobs, reviews, timing).where("section = 'data_health'").first().status == "empty"


def test_financial_plan_against_its_profile(spark):
    plans = spark.createDataFrame([(1, "p", "v1", 10, True), (2, "p", "v2", 99, False), (3, "q", "v1", 1, True)], "plan_id int, provider_id string, profile_version string, bucket_size int, bulk_acknowledged boolean")
    profiles = spark.createDataFrame([("p", "v1", 50, True)], "provider_id string, version string, row_limit int, bulk_allowed boolean")
    scopes = spark.createDataFrame([("p", "XSHG", "income")], "provider_id string, market string, statement string")
    asked = spark.createDataFrame([(1, "XSHG", "income"), (2, "XSHG", "cash"), (2, "XSHG", "cash")], "plan_id int, market string, statement string")
    got = {r.plan_id: (r.blockers, r.permitted) for r in audit.qualify_financial_plan(plans, profiles, scopes, asked).collect()}
    assert got == {1: ([], True), 2: (["bucket_exceeds_row_limit", "bulk_not_acknowledged", "not_covered:XSHG:cash", "profile_version"], False), 3: (["provider_unknown"], False)}


def test_a_recorded_baseline_of_another_target_conflicts(spark):
    closes = spark.createDataFrame([("k", D(2020, 1, d), 10.0 + d % 3) for d in range(1, 9)], "k string, d date, c double")
    recorded = spark.createDataFrame([("k", D(2020, 1, 7), 0.2), ("k", D(2020, 1, 8), 0.3)], "k string, d date, target double")
    rows = transforms.timing_baseline(closes, closes.select("k"), "k", "d", "c", 0.2, 1.0, window=3, recorded=recorded).orderBy("d").collect()
    assert [r.action for r in rows[-3:]] == ["insert", "duplicate", "conflict"] and rows[-2].exposure > 0 and rows[-1].exposure is None is rows[-1].value


def test_revision_needs_an_attested_source(spark):
    shots = spark.createDataFrame([("s", 2020, p, D(2020, 1, m), 1.0 * m, 2.0 * m, D(2021, 1, 1), D(2020, 1, 20)) for p in "abcdef" for m in (1, 2)] + [("s", 2020, "a", D(2020, 2, 1), 1.0, 1.0, D(2021, 1, 1), D(2020, 1, 20))], "security_id string, period int, provider_id string, observed_on date, estimate_lo double, estimate_hi double, valid_to date, decision_on date")
    strict = "strict_historical"
    attested = [("a", strict, D(2019, 1, 1), None, 2), ("b", "private", D(2019, 1, 1), None, 2), ("c", strict, D(2020, 3, 1), None, 2), ("d", strict, D(2019, 1, 1), D(2020, 1, 1), 2), ("d", strict, D(2020, 6, 1), None, 2), ("e", strict, D(2019, 1, 1), None, 1)]
    a = spark.createDataFrame(attested, "provider_id string, provider_use string, qualified_on date, valid_until date, ceiling int")
    got = {(r.provider_id, r.observed_on.month, r.observed_on.day): (r.value, r.unavailable_reason, r.revision_lo) for r in valuation.revision(shots, a).collect()}
    assert got["a", 1, 2] == (1.5, None, 0.0) and got["a", 1, 1][1] == "no_prior_estimate" and got["a", 2, 1] == (None, "snapshot_after_decision", None)
    assert [got[p, 1, 2][1] for p in "bcdef"] == ["attested_for_other_use", "qualified_after_decision", "attestation_expired", "trust_ceiling", "source_not_attested"]
    assert valuation.revision(shots).where("value is not null").count() == 7


def test_the_model_suite_has_a_status_of_its_own(spark):
    done = lambda k, names, status="quantified": [(k, n, status) for n in names]
    rows = done(1, valuation.COMPONENTS) + done(1, valuation.SUITE[:3]) + done(1, valuation.SUITE[3:], "unavailable") + done(2, valuation.COMPONENTS, "unavailable") + done(2, valuation.SUITE) + done(3, valuation.COMPONENTS[:2])
    got = {r.security_id: (r.status, r.suite_status, r.open_models) for r in valuation.analyze(spark.createDataFrame(rows, "security_id int, component string, status string")).collect()}
    assert got == {1: ("quantified", "partial", ["revision"]), 2: ("unavailable", "quantified", []), 3: ("partial", None, [])}


def test_records_of_two_contents(spark):
    rows = [("s", m, 1, "d", "x", k, h, "pit_verified", D(2020, 1, 1)) for m, k, h in (("profit", 1, "a"), ("equity", 1, "b"))] + [("t", "profit", 1, "d", "x", 1, "a", "pit_verified", D(2020, 1, 1)), ("t", "equity", 1, "e", "x", 2, "a", "pit_verified", D(2020, 1, 2))]
    df = spark.createDataFrame(rows, "security_id string, metric string, period int, dataset_id string, source_id string, record_id int, content_hash string, trust_state string, available_at date")
    got = {r.security_id: (r.n_records, r.n_hashes, r.blockers) for r in valuation.qualify_inputs(df, ["profit", "equity"]).collect()}
    assert got == {"s": (1, 2, ["record_of_two_contents"]), "t": (2, 1, [])}
