"""Cross-sectional transforms over all periods at once, labels, volatility and feature formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .status import columns, ratio


def winsorize(df: DataFrame, by: Sequence[str], value: str, lower: float, upper: float, min_obs: int = 2) -> DataFrame:
    """Clip to the (n-1)p linearly interpolated quantiles of each group. Missing stays missing."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("0 <= lower < upper <= 1")
    bounds = df.groupBy(*by).agg(F.count(value).alias("_n"), F.expr(f"percentile(`{value}`, array({lower}D, {upper}D))").alias("_b"))
    out = df.join(bounds, list(by))
    clipped = F.least(F.greatest(F.col(value), F.col("_b")[0]), F.col("_b")[1])
    few = F.col("_n") < max(1, min_obs)
    return out.select(*[c for c in df.columns], *columns(clipped, ("insufficient_observations", few), ("missing_value", F.col(value).isNull())))


def zscore(df: DataFrame, by: Sequence[str], value: str, ddof: int = 1, min_obs: int = 2) -> DataFrame:
    """(x - mean) / sd of each group with ``ddof`` degrees taken off."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    scale = F.sqrt(F.try_divide(n.cast("double"), (n - ddof).cast("double")))
    out = df.select("*", n.alias("_n"), F.avg(value).over(w).alias("_m"), (F.stddev_pop(value).over(w) * scale).alias("_s"))
    few = (F.col("_n") < min_obs) | (F.col("_n") <= ddof)
    return out.select(*df.columns, *columns(ratio(F.col(value) - F.col("_m"), F.col("_s")), ("insufficient_observations", few), ("zero_variance", F.col("_s") == 0), ("missing_value", F.col(value).isNull())))


def neutralize(df: DataFrame, by: Sequence[str], value: str, industry: str, size: str, tolerance: float = 1e-12) -> DataFrame:
    """Residual of a regression on industry dummies and size, by demeaning within (group, industry).

    One aggregation by (group, industry), summed up by group, gives all moments; rows meet them in one join."""
    whole = F.col(value).isNotNull() & F.col(industry).isNotNull() & F.col(size).isNotNull()
    y, x = F.col(value).cast("double"), F.col(size).cast("double")
    n = F.count("*")
    inner = df.where(whole).groupBy(*by, F.col(industry).alias("_i")).agg(n.alias("_m"), F.avg(y).alias("_ya"), F.avg(x).alias("_xa"), (F.covar_pop(x, y) * n).alias("_c"), (F.var_pop(x) * n).alias("_v"))
    outer = inner.groupBy(*by).agg(F.sum("_m").alias("_n"), F.count("*").alias("_k"), F.sum("_c").alias("_xy"), F.sum("_v").alias("_xx"))
    moments = inner.drop("_m", "_c", "_v").join(outer, list(by))
    rows = df.withColumn("_i", F.when(whole, F.col(industry))).join(moments, [*by, "_i"], "left")
    residual = (y - F.col("_ya")) - ratio(F.col("_xy"), F.col("_xx")) * (x - F.col("_xa"))
    return rows.select(*df.columns, *columns(residual, ("missing_value", F.col(value).isNull()), ("missing_industry", F.col(industry).isNull()), ("missing_size", F.col(size).isNull()), ("insufficient_observations", F.coalesce(F.col("_n") <= F.col("_k") + 1, F.lit(True))), ("singular", F.col("_xx") <= tolerance)))


def formula(df: DataFrame, inputs: Sequence[str], expression: str) -> DataFrame:
    """A named SQL expression over input columns; any missing input makes the row unavailable."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in inputs]))
    return df.withColumn("missing_inputs", gaps).select(*df.columns, "missing_inputs", *columns(F.expr(expression).cast("double"), ("missing_input", F.size("missing_inputs") > 0), ("undefined", F.expr(expression).isNull())))


def pivot_inputs(facts: DataFrame, keys: Sequence[str], name: str, value: str, inputs: Sequence[str]) -> DataFrame:
    """Long facts to one column per input name."""
    return facts.where(F.col(name).isin(*inputs)).groupBy(*keys).agg(*[F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in inputs])


def feature(facts: DataFrame, keys: Sequence[str], inputs: Mapping[str, tuple[str, str | None]], expression: str, missing: str = "unavailable") -> DataFrame:
    """A feature formula over long facts (keys, metric, value, unit, currency, period): one row a key.

    inputs: metric -> (unit, currency or None). An input of another unit or currency, or inputs of several periods, make
    the row unavailable; a missing input makes it unavailable or, by the policy ``reject``, rejected: such a row must not
    be stored as a feature at all. Of several facts of one metric and key the greatest value counts."""
    if missing not in ("unavailable", "reject"):
        raise ValueError("missing is unavailable or reject")
    m = F.col("metric")
    unit = F.coalesce(*[F.when(m == n, F.lit(u)) for n, (u, _) in inputs.items()])
    currency = F.coalesce(*[F.when(m == n, F.lit(c)) for n, (_, c) in inputs.items()])
    own = facts.where(m.isin(*inputs) & F.col("value").isNotNull()).withColumns({"_u": ~F.col("unit").eqNullSafe(unit), "_c": currency.isNotNull() & ~F.col("currency").eqNullSafe(currency)})
    picks = [F.max(F.when(m == n, F.col("value"))).alias(n) for n in inputs]
    every = facts.select(*keys).distinct()
    g = own.groupBy(*keys).agg(*picks, F.max("_u").alias("_u"), F.max("_c").alias("_c"), F.count_distinct("period").alias("_p"))
    g = every.join(g, list(keys), "left")
    gaps = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in inputs]))
    value = F.expr(expression).cast("double")
    g = g.withColumn("missing_inputs", gaps)
    out = g.select(*keys, "missing_inputs", *columns(value, ("missing_input", F.size("missing_inputs") > 0), ("unit_mismatch", F.col("_u")), ("currency_mismatch", F.col("_c")), ("period_mismatch", F.col("_p") > 1), ("undefined", value.isNull())))
    if missing == "reject":
        out = out.withColumn("status", F.when(F.size("missing_inputs") > 0, "rejected").otherwise(F.col("status")))
    return out


def snapshot(df: DataFrame, by: Sequence[str], entity: str, value: str, industry: str, size: str, version: str, lower: float = 0.01, upper: float = 0.99, formula: str = "") -> DataFrame:
    """Stages raw, winsorized, standardized and neutralized as rows with a content id of (version,
    hash of the formula, stage, keys, raw input, value); numbers count in millionths."""
    keys = [*by, entity, industry, size]
    base = df.select(*keys, F.col(value).cast("double").alias("raw"))
    w = winsorize(base, by, "raw", lower, upper).select(*keys, "raw", F.col("value").alias("winsorized"))
    z = zscore(w, by, "winsorized").select(*keys, "raw", "winsorized", F.col("value").alias("standardized"))
    n = neutralize(z, by, "standardized", industry, size).select(*by, entity, F.col("raw").alias("input"), "raw", "winsorized", "standardized", F.col("value").alias("neutralized"))
    stages = n.unpivot([*by, entity, "input"], ["raw", "winsorized", "standardized", "neutralized"], "stage", "value")
    number = lambda c: F.coalesce(F.floor(F.col(c) * 1e6 + 0.5).cast("string"), F.lit(""))
    content = F.sha2(F.concat_ws("|", F.lit(version), F.sha2(F.lit(formula), 256), "stage", *[F.col(c).cast("string") for c in [*by, entity]], number("input"), number("value")), 256)
    return stages.select(*by, entity, "stage", content.alias("snapshot_id"), "value", F.when(F.col("value").isNull(), "unavailable").otherwise("quantified").alias("status"))


def forward_return(prices: DataFrame, horizon: int, decisions: DataFrame | None = None, key: str = "listing_id", session: str = "session_date") -> DataFrame:
    """Return over ``horizon`` sessions from each decision session. prices: key, session, close, tradable."""
    w = Window.partitionBy(key).orderBy(session)
    p = prices.select(key, session, F.col("close").cast("double").alias("c0"), F.lead("close", horizon).over(w).cast("double").alias("c1"), "tradable", F.lead("tradable", horizon).over(w).alias("t1"), F.lead(session, horizon).over(w).alias("end_session"), F.lit(True).alias("known"))
    if decisions is not None:
        p = decisions.select(key, session).join(p, [key, session], "left")
    shut = ~F.coalesce(F.col("tradable"), F.lit(False)) | ~F.coalesce(F.col("t1"), F.lit(False))
    return p.select(key, session, "end_session", *columns(ratio(F.col("c1") - F.col("c0"), F.col("c0")), ("decision_session_missing", F.col("known").isNull()), ("horizon_incomplete", F.col("end_session").isNull()), ("not_tradable", shut), ("invalid_price", F.coalesce(F.col("c0") <= 0, F.lit(True)) | F.col("c1").isNull())))


def passive_volatility(closes: DataFrame, key: str, session: str, close: str, window: int = 20, sessions_a_year: int = 244) -> DataFrame:
    """Annualised sample deviation of the last ``window`` log returns; needs that many."""
    w = Window.partitionBy(key).orderBy(session)
    r = closes.select(key, session, F.ln(F.try_divide(F.col(close), F.lag(close).over(w))).alias("r"))
    last = w.rowsBetween(1 - window, 0)
    g = r.select(key, session, F.count("r").over(last).alias("n"), (F.stddev_samp("r").over(last) * F.sqrt(F.lit(float(sessions_a_year)))).alias("v"))
    return g.select(key, session, *columns(F.col("v"), ("insufficient_history", F.col("n") < window)))


def exposure(vol: DataFrame, target: float, maximum: float) -> DataFrame:
    """min(maximum, target / observed) from the ``value`` of a volatility row."""
    e = F.when(F.col("value").isNotNull(), F.least(F.lit(maximum), ratio(F.lit(target), F.col("value"))))
    flat = F.coalesce(F.col("value") <= 0, F.lit(False))
    return vol.select("*", F.when(~flat, e).alias("exposure"), F.when(flat, "zero_volatility").otherwise(F.col("unavailable_reason")).alias("exposure_reason"))


def timing_baseline(closes: DataFrame, active: DataFrame, key: str, session: str, close: str, target: float, maximum: float, window: int = 20, recorded: DataFrame | None = None) -> DataFrame:
    """One row per (key, session) whose key has an active universe: volatility, target exposure, static exposure 1.

    Against the rows recorded before (key, session, target) each is an insert, a duplicate, or, if one of them has another
    target, a conflict without values."""
    rows = exposure(passive_volatility(closes, key, session, close, window), target, maximum)
    rows = rows.join(active.select(key).distinct(), key, "left_semi").withColumn("static_exposure", F.lit(1.0))
    if recorded is None:
        return rows
    known = recorded.groupBy(key, session).agg((F.count_if(~F.col("target").eqNullSafe(F.lit(target))) > 0).alias("_other"))
    met = rows.join(known, [key, session], "left").withColumn("action", F.when(F.col("_other").isNull(), "insert").when(F.col("_other"), "conflict").otherwise("duplicate"))
    return met.drop("_other").withColumns({c: F.when(F.col("action") != "conflict", F.col(c)) for c in ("value", "exposure")})
