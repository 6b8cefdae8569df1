"""Fundamental improvement and quality factors for all entities and quarters at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scd import contains
from .status import columns, ratio


def quarter_points(metrics: DataFrame, lags: Sequence[int], entity: str = "entity_id") -> DataFrame:
    """(entity, metric, q) with the values at q - lag as v_<lag>; gaps give NULL, unlike a row lag. One aggregation."""
    at = F.explode(F.array(*[F.struct((F.col("q") + k).alias("q"), F.lit(k).alias("lag")) for k in lags]))
    spread = metrics.select(entity, "metric", "value", at.alias("x")).select(entity, "metric", "x.q", "x.lag", "value")
    g = spread.groupBy(entity, "metric", "q").agg(*[F.max(F.when(F.col("lag") == k, F.col("value"))).alias(f"v_{k}") for k in lags], F.max((F.col("lag") == 0).cast("int")).alias("here"))
    return g.where("here = 1").drop("here")


#: Treatments of an observation that leave its change without meaning, and the reason given.
UNSOUND = {
    "seasonality": ("seasonality_uncontrolled", ("uncontrolled", "unknown")),
    "base_effect": ("base_effect_unadjusted", ("present_unadjusted", "unknown")),
    "one_off": ("one_off_unadjusted", ("included_unadjusted", "unknown")),
}


def improvement(metrics: DataFrame, seasonal: bool = True, difference_metrics: Sequence[str] = (), one_offs: DataFrame | None = None, treatments: DataFrame | None = None, entity: str = "entity_id") -> DataFrame:
    """Level, trend and acceleration of each metric: the year-on-year (q against q-4) or quarter-on-quarter change, that
    of the quarter before, and their difference. Changes are ratios, for ``difference_metrics`` differences; a non-positive
    base is unavailable. one_offs (entity, metric, q, amount) are taken off first.

    treatments (entity, metric, q, seasonality, base_effect, one_off), if given, say how each observation was prepared: one
    without a row, or with seasonality uncontrolled, a base effect left in, one-offs left in, or any of these unknown, is
    unavailable."""
    if one_offs is not None:
        off = one_offs.groupBy(entity, "metric", "q").agg(F.sum("amount").alias("_off"))
        metrics = metrics.join(off, [entity, "metric", "q"], "left").withColumn("value", F.col("value") - F.coalesce("_off", F.lit(0.0))).drop("_off")
    a, b, c, d = (0, 4, 1, 5) if seasonal else (0, 1, 1, 2)
    p = quarter_points(metrics, sorted({a, b, c, d}), entity)
    plain = F.col("metric").isin(*difference_metrics) if difference_metrics else F.lit(False)

    def change(x: int, y: int) -> Column:
        now, base = F.col(f"v_{x}"), F.col(f"v_{y}")
        return F.when(plain, now - base).otherwise(ratio(now, base) - 1)

    gap = F.greatest(*[F.col(f"v_{k}").isNull().cast("int") for k in {a, b, c, d}]) == 1
    base = ~plain & (F.least(F.col(f"v_{b}"), F.col(f"v_{d}")) <= 0)
    gates: list[tuple[str, Column]] = []
    if treatments is not None:
        t = treatments.groupBy(entity, "metric", "q").agg(*[F.min(c).alias(c) for c in UNSOUND])
        p = p.join(t, [entity, "metric", "q"], "left")
        gates = [("treatment_missing", F.col("seasonality").isNull()), *((name, F.col(c).isin(*bad)) for c, (name, bad) in UNSOUND.items())]
    trend = ~gap & ~base
    for _, holds in gates:
        trend = trend & ~F.coalesce(holds, F.lit(False))
    return p.select(entity, "metric", "q", F.col("v_0").alias("level"), F.when(trend, change(a, b)).alias("trend"), *columns(change(a, b) - change(c, d), *gates, ("missing_quarter", gap), ("non_positive_base", base)))


def improvement_window(metrics: DataFrame, required: Sequence[str], lags: Sequence[int] = (0, 1, 4, 5), entity: str = "entity_id") -> DataFrame:
    """The newest quarter of each entity at which all required metrics have all lagged points."""
    p = quarter_points(metrics.where(F.col("metric").isin(*required) & F.col("value").isNotNull()), lags, entity)
    whole = p.where(" and ".join(f"v_{k} is not null" for k in lags)).groupBy(entity, "q").agg(F.count("*").alias("n"))
    return whole.where(F.col("n") == len(required)).groupBy(entity).agg(F.max("q").alias("q"))


def improvement_summary(improved: DataFrame, required: int, entity: str = "entity_id") -> DataFrame:
    """Breadth: share of quantified metrics that accelerate; confidence: quantified over required."""
    g = improved.groupBy(entity, "q").agg(F.count("value").alias("n"), F.count_if(F.col("value") > 0).alias("up"))
    state = F.when(F.col("n") >= required, "quantified").when(F.col("n") > 0, "partial").otherwise("unavailable")
    return g.select(entity, "q", F.col("n").alias("n_quantified"), ratio(F.col("up"), F.col("n")).alias("breadth"), (F.col("n") / F.lit(required)).alias("confidence"), state.alias("status"))


#: Quality ratios by numerator and denominator metric.
QUALITY_RATIOS = {
    "cash_to_profit": ("operating_cash_flow", "net_profit"),
    "liabilities_to_assets": ("total_liabilities", "total_assets"),
    "return_on_equity": ("net_profit", "total_equity"),
    "return_on_invested_capital": ("operating_profit_after_tax", "invested_capital"),
    "interest_cover": ("operating_profit", "interest_expense"),
    "accruals_to_assets": ("accruals", "total_assets"),
    "asset_turnover": ("revenue", "total_assets"),
    "capital_adequacy": ("regulatory_capital", "risk_weighted_assets"),
    "non_performing_loans": ("non_performing_loans", "total_loans"),
    "net_interest_margin": ("net_interest_income", "interest_earning_assets"),
}


def quality_ratios(metrics: DataFrame, keys: Sequence[str], ratios: Mapping[str, tuple[str, str]] = QUALITY_RATIOS) -> DataFrame:
    """Long ratios from long metrics: one pivoting aggregation, then divisions; a missing or zero denominator is unavailable."""
    names = sorted({m for pair in ratios.values() for m in pair})
    wide = metrics.where(F.col("metric").isin(*names)).groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for r, (a, b) in ratios.items()]))
    x = wide.select(*keys, each.alias("x")).select(*keys, "x.*")
    return x.select(*keys, "ratio", *columns(ratio(F.col("a"), F.col("b")), ("missing_input", F.col("a").isNull() | F.col("b").isNull()), ("zero_denominator", F.col("b") == 0)))


def dispersion(metrics: DataFrame, keys: Sequence[str], min_obs: int = 4) -> DataFrame:
    """Margin stability: sample deviation of a metric over an entity's quarters."""
    g = metrics.groupBy(*keys).agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
    return g.select(*keys, "n", *columns(F.col("sd"), ("insufficient_observations", F.col("n") < min_obs)))


def resolve_thresholds(requests: DataFrame, rules: DataFrame, bindings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """requests (company, template, feature, as_of): the rule of template and feature, its approved threshold in effect, and
    company exceptions that make it not applicable. Catalogs are small and joined by key."""
    r = requests.join(rules.select("template", "feature", "rule_id", "comparator"), ["template", "feature"], "left")
    b = bindings.where("status = 'approved'").select(F.col("rule_id").alias("_r"), "threshold", "valid_from", "valid_to")
    hit = r.join(b, (F.col("rule_id") == F.col("_r")) & contains(F.col("as_of")), "left")
    key = ["company_id", "template", "feature", "as_of", "rule_id", "comparator"]
    g = hit.groupBy(*key).agg(F.count("threshold").alias("n"), F.min("threshold").alias("threshold"))
    e = exceptions.select(F.col("company_id").alias("_c"), F.col("rule_id").alias("_x"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    out = g.join(e, (F.col("company_id") == F.col("_c")) & (F.col("rule_id") == F.col("_x")) & contains(F.col("as_of"), "_f", "_t"), "left")
    state = F.when(F.col("rule_id").isNull(), "no_rule").when(F.col("_x").isNotNull(), "not_applicable").when(F.col("n") == 0, "no_threshold").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return out.select(*key[:4], "rule_id", "comparator", F.when(state == "resolved", F.col("threshold")).alias("threshold"), state.alias("status")).distinct()


def quality(values: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("company_id", "as_of")) -> DataFrame:
    """Pass rate of a company's governed checks (minimum: >=, maximum: <=). Any missing or not applicable part makes the
    factor unavailable. values: keys, feature, value; thresholds as resolved."""
    x = thresholds.join(values, [*keys, "feature"], "left")
    ok = F.when(F.col("comparator") == "minimum", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    x = x.withColumn("pass", F.when(F.col("status") == "resolved", ok))
    g = x.groupBy(*keys).agg(F.count("*").alias("n_checks"), F.count_if(F.col("status") != "resolved").alias("n_unresolved"), F.count_if((F.col("status") == "resolved") & F.col("pass").isNull()).alias("n_missing"), F.avg(F.col("pass").cast("double")).alias("rate"))
    return g.select(*keys, "n_checks", *columns(F.col("rate"), ("threshold_unresolved", F.col("n_unresolved") > 0), ("missing_value", F.col("n_missing") > 0)))
