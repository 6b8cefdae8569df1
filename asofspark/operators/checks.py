"""Data checks as tables of violations (rule, key, detail): one bad key never stops a job over millions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule. rules: name -> condition that marks a violation; NULL is none."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def bar_rules() -> dict[str, Column]:
    o, h, low, c, prev = (F.col(x) for x in ("open", "high", "low", "close", "previous_close"))
    return {
        "missing_price": o.isNull() | h.isNull() | low.isNull() | c.isNull(),
        "non_positive_price": (F.least(o, h, low, c) <= 0),
        "non_positive_previous_close": prev <= 0,
        "high_below_range": h < F.greatest(o, low, c),
        "low_above_range": low > F.least(o, h, c),
        "missing_volume": F.col("volume").isNull(),
        "negative_volume": F.col("volume") < 0,
        "negative_amount": F.col("amount") < 0,
        "bad_currency": ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)),
    }


def state_rules() -> dict[str, Column]:
    return {"trading_and_suspended": F.col("is_trading") & F.col("is_suspended"), "terminated_trades": (F.col("listing_state") == "terminated") & F.col("is_trading")}


def capital_rules() -> dict[str, Column]:
    t, c, f, r = (F.col(x) for x in ("total_shares", "circulating_shares", "free_float_shares", "restricted_shares"))
    return {"circulating_above_total": c > t, "float_without_circulating": f.isNotNull() & c.isNull(), "float_above_circulating": f > c, "parts_above_total": c + r > t}


def action_rules() -> dict[str, Column]:
    kind, cash, share, sub = F.col("action_type"), F.col("cash_per_share"), F.col("share_ratio"), F.col("subscription_price")
    return {
        "record_after_ex": F.col("record_date") > F.col("ex_date"),
        "cash_dividend_without_cash": (kind == "cash_dividend") & cash.isNull(),
        "stock_dividend_without_ratio": (kind == "stock_dividend") & share.isNull(),
        "rights_incomplete": (kind == "rights") & (share.isNull() | sub.isNull()),
    }


def membership_rules() -> dict[str, Column]:
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return {
        "tradable_not_research": F.col("tradable_eligible") & ~F.col("research_eligible"),
        "research_without_reason": F.col("research_eligible") & (n("inclusion_reasons") <= 0),
        "untradable_without_reason": ~F.col("tradable_eligible") & (n("exclusion_reasons") <= 0),
    }


def view_rules(tolerance: float = 1e-9) -> dict[str, Column]:
    return {
        "quantiles_out_of_order": ~((F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))),
        "point_outside_interval": ~F.col("expected_return").between(F.col("p10"), F.col("p90")),
        "downside_above_point": F.col("downside") > F.col("expected_return"),
        "not_reconciled": F.abs(F.col("component_sum") + F.col("residual") - F.col("expected_return")) > tolerance,
    }


def split_rules() -> dict[str, Column]:
    names = ("train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end")
    ts, te, vs, ve, xs, xe = (F.col(n) for n in names)
    return {"empty_window": (ts >= te) | (vs >= ve) | (xs >= xe), "train_overlaps_validation": te > vs, "validation_overlaps_test": ve > xs}


def universe_version_rules() -> dict[str, Column]:
    pit = F.col("trust_state") == "pit_verified"
    return {
        "pit_without_available_at": pit & F.col("available_at").isNull(),
        "non_pit_with_available_at": ~pit & F.col("available_at").isNotNull(),
        "discrete_without_dates": (F.col("mode") == "discrete") & (F.coalesce(F.size("observed_dates"), F.lit(0)) <= 0),
        "gap_not_forward": F.exists("gaps", lambda g: g["end"] <= g["start"]),
    }


def outcome_rules() -> dict[str, Column]:
    return {"realized_before_decision": F.col("realized_at") <= F.col("decision_at"), "source_before_realized": F.col("source_available_at") < F.col("realized_at"), "recorded_before_source": F.col("recorded_at") < F.col("source_available_at"), "identity_differs": ~F.col("security_id").eqNullSafe(F.col("view_security_id"))}


def signal_rules(horizons: Sequence[int] = (20, 60, 120)) -> dict[str, Column]:
    return {"rank_out_of_range": ~F.col("rank").between(F.lit(1), F.col("universe_size")), "previous_rank_out_of_range": ~F.col("previous_rank").between(F.lit(1), F.col("universe_size")), "confidence_out_of_range": ~F.col("confidence").between(0, 1), "clock_out_of_order": (F.col("cutoff") > F.col("decision_time")) | (F.col("decision_time") > F.col("created_at")), "unknown_horizon": ~F.col("horizon").isin(*horizons)}


def forecast_rules(zone: str = "Asia/Shanghai") -> dict[str, Column]:
    number = F.col("p10").isNotNull() | F.col("p50").isNotNull() | F.col("p90").isNotNull()
    return {
        "unknown_horizon": ~F.col("horizon").isin(1, 5, 20, 60),
        "quantiles_out_of_order": (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")),
        "ratio_out_of_range": ~F.col("exposure").between(0, 1),
        "bounds_out_of_order": F.col("lower_bound") > F.col("upper_bound"),
        "clock_out_of_order": (F.col("cutoff") > F.col("decision_time")) | (F.col("decision_time") > F.col("created_at")),
        "session_not_local_date": F.to_date(F.from_utc_timestamp("decision_time", zone)) != F.col("session_date"),
        "unavailable_with_numbers": (F.col("status") == "unavailable") & number,
    }


def forecast_horizons(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Forecasts whose horizons aren't exactly 1, 5, 20 and 60."""
    g = df.groupBy(*key).agg(F.array_sort(F.collect_list("horizon")).alias("horizons"))
    return g.where(F.col("horizons") != F.array(*[F.lit(h) for h in (1, 5, 20, 60)]))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    return child.join(parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_anti")


def single_version(df: DataFrame, by: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Groups that mix versions."""
    g = df.groupBy(*by).agg(*[F.count_distinct(v).alias(f"n_{v}") for v in versions])
    return g.where(" or ".join(f"n_{v} > 1" for v in versions))


def linear_rules(facts: DataFrame, rules: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Financial identities sum(coef * value) = 0 within a tolerance. rules: rule_id, severity, tolerance, terms
    array<struct<metric, coef>>; facts: entity columns, metric, value. A missing term makes the rule unavailable."""
    terms = F.broadcast(rules.select("rule_id", "severity", "tolerance", F.size("terms").alias("n_terms"), F.explode("terms").alias("t")).select("rule_id", "severity", "tolerance", "n_terms", "t.metric", "t.coef"))  # the rule catalog
    g = facts.join(terms, "metric").groupBy(*entity, "rule_id", "severity", "tolerance", "n_terms").agg(F.count("value").alias("n"), F.sum(F.col("coef") * F.col("value")).alias("residual"), F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.col("metric")))).alias("present"))
    ok = F.col("n") == F.col("n_terms")
    passed = F.abs("residual") <= F.col("tolerance")
    return g.select(*entity, "rule_id", F.when(ok, F.col("residual")).alias("residual"), "present", F.when(~ok, "unavailable").when(passed, "passed").otherwise("failed").alias("status"), (F.col("severity").eqNullSafe("block") & ~F.coalesce(ok & passed, F.lit(False))).alias("blocks"))


def disclosure_chain(versions: DataFrame) -> DataFrame:
    """Breaks of a chain: start, step, supersedes, time, identity and status rules of each document's versions."""
    w = Window.partitionBy("document_key").orderBy("version_sequence", "disclosure_id")
    prev = lambda c: F.lag(c).over(w)
    first = prev("version_sequence").isNull()
    rules = {
        "does_not_start_at_zero": first & (F.col("version_sequence") != 0),
        "sequence_gap": ~first & (F.col("version_sequence") != prev("version_sequence") + 1),
        "wrong_supersedes": ~F.col("supersedes_id").eqNullSafe(prev("disclosure_id")),
        "published_before_previous": F.col("published_at") < prev("published_at"),
        "identity_changed": ~first & ~F.col("company_id").eqNullSafe(prev("company_id")),
        "available_before_published": F.col("available_at") < F.col("published_at"),
        "tradable_before_available": F.col("first_tradable_at") < F.col("available_at"),
        "wrong_status": F.when(F.col("version_sequence") == 0, F.col("status") != "published").otherwise(~F.col("status").isin("corrected", "withdrawn")),
    }
    flagged = versions.withColumn("_rules", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return flagged.select("document_key", "version_sequence", F.explode("_rules").alias("rule"))


def membership_gates(step_rows: DataFrame, least: int, most: int, max_change: float) -> DataFrame:
    return violations(step_rows, ["universe_id", "session_date"], {"cardinality_out_of_range": ~F.col("members").between(least, most), "change_too_large": F.col("change_ratio") > max_change})


def lifecycle_replay(events: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Transitions that are not allowed, out of order, or reach production without approval. events: key, sequence,
    occurred_at, from_status, to_status, approved."""
    w = Window.partitionBy(key).orderBy("sequence")
    x = events.withColumns({"_prev": F.lag("to_status").over(w), "_before": F.lag("occurred_at").over(w)})
    known = F.broadcast(allowed.select("from_status", "to_status", F.lit(True).alias("_ok")))  # the table of allowed pairs
    x = x.join(known, ["from_status", "to_status"], "left")
    return violations(x, [key, "sequence"], {"not_allowed": F.col("_ok").isNull(), "does_not_continue": F.col("_prev") != F.col("from_status"), "out_of_order": F.col("occurred_at") < F.col("_before"), "production_without_approval": (F.col("to_status") == "production") & ~F.coalesce("approved", F.lit(False))})


def monotone_sessions(df: DataFrame, key: str, session: str, close: str, order: str) -> DataFrame:
    """Dates that don't increase in row order, and closes that aren't positive."""
    x = df.withColumn("_before", F.lag(session).over(Window.partitionBy(key).orderBy(order)))
    return violations(x, [key, order], {"session_not_increasing": F.col(session) <= F.col("_before"), "non_positive_close": F.coalesce(F.col(close) <= 0, F.lit(True))})


