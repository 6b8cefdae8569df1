"""Factor statistics over all periods at once: one row per group, in one or two shuffles on the group's keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .status import QUANTIFIED, columns, ratio


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, NULL where a side is constant, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))))


def ic(df: DataFrame, by: Sequence[str], score: str, label: str, kind: str = "pearson", min_obs: int = 3) -> DataFrame:
    """Information coefficient of each cross-section over complete pairs."""
    min_obs = max(3, min_obs)
    complete = F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(score) & ~F.isnan(label)
    rows = df.select(*by, F.when(complete, F.col(score).cast("double")).alias("x"), F.when(complete, F.col(label).cast("double")).alias("y"))
    if kind == "spearman":
        both = rows.where("x is not null")
        ranked = both.select(*by, average_rank("x", by).alias("x"), average_rank("y", by).alias("y"))
        rows = ranked.unionByName(rows.where("x is null"))
    grouped = rows.groupBy(*by).agg(F.count("x").alias("n_obs"), F.count_if(F.col("x").isNull()).alias("n_missing"), correlation("x", "y").alias("r"), F.least(F.stddev_pop("x"), F.stddev_pop("y")).alias("spread"))
    return grouped.select(*by, "n_obs", "n_missing", *columns(F.col("r"), ("insufficient_observations", F.col("n_obs") < min_obs), ("zero_variance", F.coalesce(F.col("spread") == 0, F.lit(True)))))


def quantile_portfolios(df: DataFrame, by: Sequence[str], score: str, label: str, entity: str, quantiles: int, min_obs: int) -> DataFrame:
    """One row per group and bucket min(q-1, floor(i*q/n)) in (score, entity) order: mean, count, and the group's
    top-minus-bottom and share of non-falling steps."""
    complete = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy(*by)
    i = F.row_number().over(w.orderBy(score, entity)) - 1
    n = F.count("*").over(w)
    placed = complete.select(*by, F.col(label).alias("y"), n.alias("n_obs"), F.least(F.lit(quantiles - 1), F.floor(i * quantiles / n)).cast("int").alias("bucket"))
    means = placed.groupBy(*by, "n_obs", "bucket").agg(F.avg("y").alias("mean_return"), F.count("*").alias("n_bucket"))
    step = F.lead("mean_return").over(w.orderBy("bucket")) - F.col("mean_return")
    means = means.withColumn("step", step)
    top = F.max(F.when(F.col("bucket") == quantiles - 1, F.col("mean_return"))).over(w)
    bottom = F.max(F.when(F.col("bucket") == 0, F.col("mean_return"))).over(w)
    rising = F.avg((F.col("step") >= 0).cast("double")).over(w)
    out = means.select(*by, "n_obs", "bucket", "mean_return", "n_bucket", (top - bottom).alias("v"), rising.alias("monotonicity"))
    few = F.col("n_obs") < max(min_obs, quantiles)
    return out.select(*by, "n_obs", "bucket", "n_bucket", F.when(~few, F.col("mean_return")).alias("mean_return"), F.when(~few, F.col("monotonicity")).alias("monotonicity"), *columns(F.col("v"), ("insufficient_observations", few)))


def turnover(df: DataFrame, period: str, entity: str, weight: str, min_positions: int = 1, tolerance: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """One-way turnover between neighbouring periods: half the absolute weight changes over the union of positions."""
    sums = df.groupBy(*by, period).agg(F.count("*").alias("n"), F.count_if(F.col(weight).isNull()).alias("gaps"), F.sum(weight).alias("total"))
    order = Window.partitionBy(*by).orderBy(period)  # periods, not positions: few rows
    sums = sums.select("*", F.lead(period).over(order).alias("next_period"), F.lead("n").over(order).alias("n2"), F.lead("gaps").over(order).alias("gaps2"), F.lead("total").over(order).alias("total2")).where("next_period is not null")
    keys = [*by, period]
    now = df.join(sums.select(*keys, "next_period"), keys).select(*by, F.col(period).alias("p0"), F.col("next_period").alias("p1"), entity, (-F.col(weight)).alias("w"))
    then = df.join(sums.select(*by, F.col(period).alias("p0"), F.col("next_period").alias(period)), keys).select(*by, "p0", F.col(period).alias("p1"), entity, F.col(weight).alias("w"))
    moved = now.unionByName(then).groupBy(*by, "p0", "p1", entity).agg(F.abs(F.sum("w")).alias("d")).groupBy(*by, "p0", "p1").agg((F.sum("d") / 2).alias("v"))
    out = moved.join(sums.withColumnsRenamed({period: "p0", "next_period": "p1"}), [*by, "p0", "p1"])
    off = (F.abs(F.col("total") - 1) > tolerance) | (F.abs(F.col("total2") - 1) > tolerance)
    return out.select(*by, F.col("p0").alias("from_period"), F.col("p1").alias("to_period"), *columns(F.col("v"), ("insufficient_positions", F.least("n", "n2") < min_positions), ("missing_weight", F.greatest("gaps", "gaps2") > 0), ("weights_not_normalized", off)))


def coverage(df: DataFrame, by: Sequence[str], eligible: Column, covered: Column, min_eligible: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """Quantified eligible rows over eligible rows."""
    g = df.groupBy(*by).agg(F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & covered).alias("n_covered"))
    v = ratio(F.col("n_covered"), F.col("n_eligible"))
    few = (F.col("n_eligible") < min_eligible) | (F.col("n_eligible") == 0)
    return g.select(*by, "n_eligible", "n_covered", *columns(v, ("insufficient_eligible", few)), F.when(~few, v >= min_ratio).alias("meets_minimum"))


def decay(df: DataFrame, by: Sequence[str], horizon: str, corr: str, fraction: float = 0.5, min_horizons: int = 2) -> DataFrame:
    """Strength |corr_h| / |corr_first| by horizon; value is the first horizon whose strength is at most ``fraction``."""
    w = Window.partitionBy(*by)
    first = F.first(corr).over(w.orderBy(horizon))
    rows = df.select(*by, F.col(horizon).alias("horizon"), F.col(corr).alias("c"), first.alias("c0"), F.count(corr).over(w).alias("n"))
    rows = rows.withColumn("strength", ratio(F.abs("c"), F.abs("c0")))
    half = F.min(F.when(F.col("strength") <= fraction, F.col("horizon"))).over(w)
    bad = (F.col("n") < min_horizons, F.coalesce(F.col("c0") == 0, F.lit(True)))
    return rows.withColumn("h", half).select(*by, "horizon", F.when(~bad[0] & ~bad[1], F.col("strength")).alias("strength"), *columns(F.col("h").cast("double"), ("insufficient_horizons", bad[0]), ("zero_initial_correlation", bad[1]), ("not_reached", F.col("h").isNull())))


#: Variance relative to the mean square, and share of variance left unexplained, up to which a factor counts as dependent.
TINY, SINGULAR = 1e-20, 1e-12


def period_slopes(df: DataFrame, period: str, label: str, factors: Sequence[str], min_obs: int = 3, intercept: bool = True) -> DataFrame:
    """Slopes b0, b1, ... of one regression a period, its size ``n`` and why it is excluded, if it is.

    One aggregation gives the moments of every pair; what follows is per period. The factors are scaled to unit variance and
    eliminated one by one: a pivot is the share of a factor's variance that those before it leave unexplained, and a period
    with a pivot of SINGULAR or less is rank deficient.
    """
    factors, k = list(factors), len(factors)
    whole = F.lit(True)
    for c in [label, *factors]:
        whole = whole & F.col(c).isNotNull()
    value = lambda c: F.when(whole, F.col(c).cast("double"))
    moment = F.covar_pop if intercept else lambda a, b: F.avg(a * b)
    names = [*factors, label]
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    g = df.groupBy(period).agg(F.count_if(whole).alias("n"), *[moment(value(names[i]), value(names[j])).alias(f"s_{i}_{j}") for i, j in pairs], *[F.avg(value(f) * value(f)).alias(f"q_{i}") for i, f in enumerate(factors)])
    scale = lambda i: F.sqrt(F.col(f"s_{i}_{i}")) if i < k else F.lit(1.0)
    spread = F.lit(True)
    for i in range(k):
        spread = spread & (F.col(f"s_{i}_{i}") > TINY * F.col(f"q_{i}"))
    a = g.select(period, "n", *[scale(i).alias(f"sd_{i}") for i in range(k)], F.coalesce(spread, F.lit(False)).alias("full"), *[F.when(spread, F.col(f"s_{i}_{j}") / scale(i) / scale(j)).alias(f"a_{i}_{j}") for i, j in pairs])
    for p in range(k):  # rows and columns after p, less what factor p explains
        pivot = F.col(f"a_{p}_{p}")
        left = F.when(pivot > SINGULAR, pivot)
        a = a.withColumns({"full": F.col("full") & F.coalesce(pivot > SINGULAR, F.lit(False))} | {f"a_{i}_{j}": F.col(f"a_{i}_{j}") - F.col(f"a_{p}_{i}") * F.col(f"a_{p}_{j}") / left for i, j in pairs if i > p})
    for p in reversed(range(k)):
        rest = F.col(f"a_{p}_{k}")
        for j in range(p + 1, k):
            rest = rest - F.col(f"a_{p}_{j}") * F.col(f"z_{j}")
        a = a.withColumn(f"z_{p}", F.when(F.col("full"), rest / F.col(f"a_{p}_{p}")))
    few = F.col("n") < max(min_obs, k + 1 + intercept)
    a = a.withColumn("excluded_reason", F.when(few, "insufficient_observations").when(~F.col("full"), "rank_deficient"))
    return a.select(period, "n", "excluded_reason", *[F.when(F.col("excluded_reason").isNull(), F.col(f"z_{i}") / F.col(f"sd_{i}")).alias(f"b{i}") for i in range(k)])


def excluded_periods(df: DataFrame, period: str, label: str, factors: Sequence[str], min_obs: int = 3, intercept: bool = True) -> DataFrame:
    """The periods that ``fama_macbeth`` leaves out, with their size and reason."""
    return period_slopes(df, period, label, factors, min_obs, intercept).where("excluded_reason is not null").select(period, "n", "excluded_reason")


def fama_macbeth(df: DataFrame, period: str, label: str, factors: Sequence[str], min_obs: int = 3, min_periods: int = 2, intercept: bool = True) -> DataFrame:
    """Mean of period-wise slopes, standard error (ddof 1) and t of each factor."""
    g = period_slopes(df, period, label, factors, min_obs, intercept)
    sound = F.col("excluded_reason").isNull()
    each = g.select(sound.alias("sound"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"b{i}").alias("b")) for i, f in enumerate(factors)])).alias("x")).select("sound", "x.*")
    out = each.groupBy("factor").agg(F.count_if("sound").alias("n_periods"), F.count_if(~F.col("sound")).alias("n_excluded"), F.avg("b").alias("m"), F.stddev_samp("b").alias("sd"))
    se = F.col("sd") / F.sqrt("n_periods")
    few = F.col("n_periods") < max(2, min_periods)
    return out.select("factor", "n_periods", "n_excluded", *columns(F.col("m"), ("insufficient_periods", few)), F.when(~few, se).alias("standard_error"), F.when(~few, ratio(F.col("m"), se)).alias("t_value"))


def robustness(df: DataFrame, value: str, dims: Sequence[str], min_obs: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """n, missing, mean and sample deviation of each slice of each dimension, and per dimension the share of slices whose
    mean has the sign of the overall mean (NULL if a slice is unavailable)."""
    slices = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims], F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("slice"))))
    rows = df.select(*by, F.col(value).alias("v"), slices.alias("s")).select(*by, "v", "s.*")
    g = rows.groupBy(*by, "dimension", "slice").agg(F.count("v").alias("n_obs"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    few = F.col("n_obs") < min_obs
    g = g.select(*by, "dimension", "slice", "n_obs", "n_missing", *columns(F.col("m"), ("insufficient_observations", few)), F.when(~few, F.col("sd")).alias("sd"))
    overall = F.max(F.when(F.col("dimension") == "all", F.signum("value"))).over(Window.partitionBy(*by))
    g = g.withColumn("overall", overall)
    w = Window.partitionBy(*by, "dimension")
    agree = F.avg((F.signum("value") == F.col("overall")).cast("double")).over(w)
    whole = F.count_if(F.col("status") != QUANTIFIED).over(w) == 0
    return g.select(*by, "dimension", "slice", "n_obs", "n_missing", "value", "status", "unavailable_reason", "sd", F.when(whole, agree).alias("sign_consistency"))


def benjamini_hochberg(df: DataFrame, family: Sequence[str], hypothesis: str, p: str, alpha: float = 0.05, min_hypotheses: int = 1) -> DataFrame:
    """Step-up false-discovery control of each family: rank, critical and adjusted value, rejected."""
    w = Window.partitionBy(*family)
    order = w.orderBy(p, hypothesis)
    rows = df.select(*family, hypothesis, F.col(p).alias("p"), F.row_number().over(order).alias("rank"), F.count("*").over(w).alias("m"), F.count_if(F.col(p).isNull()).over(w).alias("gaps"))
    rows = rows.withColumn("critical", alpha * F.col("rank") / F.col("m")).withColumn("scaled", F.least(F.lit(1.0), F.col("p") * F.col("m") / F.col("rank")))
    adjusted = F.min("scaled").over(w.orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    cut = F.max(F.when(F.col("p") <= F.col("critical"), F.col("rank"))).over(w)
    rows = rows.select("*", adjusted.alias("adj"), F.coalesce(cut, F.lit(0)).alias("cut"))
    gap, few = F.col("gaps") > 0, F.col("m") < min_hypotheses
    ok = ~gap & ~few
    return rows.select(*family, hypothesis, "m", F.when(ok, F.col("rank")).alias("rank"), F.when(ok, F.col("critical")).alias("critical_value"), *columns(F.col("adj"), ("missing_p_value", gap), ("insufficient_hypotheses", few)), F.when(ok, F.col("rank") <= F.col("cut")).alias("rejected"))


def newey_west(df: DataFrame, by: Sequence[str], order: str, value: str, max_lag: int, min_obs: int = 3) -> DataFrame:
    """Mean test with Bartlett-weighted autocovariances, each normalised by n."""
    w = Window.partitionBy(*by)
    rows = df.select(*by, F.col(order).alias("o"), F.col(value).alias("v"), F.avg(value).over(w).alias("m"))
    rows = rows.withColumn("e", F.col("v") - F.col("m"))
    lagged = rows.select("*", *[F.lag("e", k).over(w.orderBy("o")).alias(f"l{k}") for k in range(1, max_lag + 1)])
    g = lagged.groupBy(*by).agg(F.count("*").alias("n_obs"), F.count_if(F.col("v").isNull()).alias("gaps"), F.avg("v").alias("m"), F.sum(F.col("e") ** 2).alias("g0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, max_lag + 1)])
    lrv = F.col("g0")
    for k in range(1, max_lag + 1):
        lrv = lrv + 2 * (1 - k / (max_lag + 1)) * F.col(f"g{k}")
    g = g.withColumn("lrv", lrv / F.col("n_obs"))
    gap, few, flat = F.col("gaps") > 0, F.col("n_obs") < max(min_obs, max_lag + 1), F.col("lrv") <= 0
    se = F.sqrt(F.col("lrv") / F.col("n_obs"))
    ok = ~gap & ~few & ~flat
    return g.select(*by, "n_obs", *columns(F.col("m"), ("missing_value", gap), ("insufficient_observations", few), ("non_positive_variance", flat)), F.when(ok, se).alias("standard_error"), F.when(ok, ratio(F.col("m"), se)).alias("t_value"))


def block_bootstrap(df: DataFrame, by: Sequence[str], order: str, value: str, block: int, resamples: int, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Circular block bootstrap interval of a mean. Starts are MD5 hashes of (seed, group, resample, block): the same on any
    partitioning. A block's sum is the difference of two prefix sums, plus the whole sum where it runs past the end, so that
    a resample costs two rows a block however long blocks are."""
    w = Window.partitionBy(*by)
    rows = df.select(*by, F.col(value).cast("double").alias("v"), F.row_number().over(w.orderBy(order)).alias("i"), F.count("*").over(w).alias("n"))
    sizes = rows.groupBy(*by).agg(F.max("n").alias("n"), F.count_if(F.col("v").isNull()).alias("gaps"), F.avg("v").alias("m"), F.sum("v").alias("total"))
    whole = sizes.where((F.col("gaps") == 0) & (F.col("n") >= block))
    runs = whole.select(*by, "n", "total", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    blocks = runs.select(*by, "n", "total", "resample", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("b"))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("resample").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n"))
    blocks = blocks.select(*by, "n", "total", "resample", start.alias("_s"), (start + F.least(F.lit(block), F.col("n") - F.col("b") * block)).alias("_e"))
    wraps = F.col("_e") > F.col("n")
    end = F.struct(F.when(wraps, F.col("_e") - F.col("n")).otherwise(F.col("_e")).alias("i"), F.lit(1).alias("sign"), F.when(wraps, F.col("total")).otherwise(F.lit(0.0)).alias("more"))
    ends = F.array(end, F.struct(F.col("_s").alias("i"), F.lit(-1).alias("sign"), F.lit(0.0).alias("more")))
    looked = blocks.select(*by, "n", "resample", F.explode(ends).alias("_x")).select(*by, "n", "resample", F.col("_x.i").alias("i"), F.col("_x.sign").alias("_sign"), F.col("_x.more").alias("_more"))
    prefix = rows.select(*by, "i", F.sum("v").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("_p")).unionByName(whole.select(*by, F.lit(0).alias("i"), F.lit(0.0).alias("_p")))
    means = looked.join(prefix, [*by, "i"]).groupBy(*by, "resample").agg((F.sum(F.col("_sign") * F.col("_p") + F.col("_more")) / F.max("n")).alias("v"))
    tail = (1 - confidence) / 2
    ends = means.groupBy(*by).agg(F.expr(f"percentile(v, array({tail}D, {1 - tail}D))").alias("e"))
    out = sizes.join(ends, list(by), "left")
    gap, short = F.col("gaps") > 0, F.col("n") < block
    return out.select(*by, F.col("n").alias("n_obs"), *columns(F.col("m"), ("missing_value", gap), ("block_longer_than_series", short)), F.col("e")[0].alias("lower"), F.col("e")[1].alias("upper"))


def crosscheck(primary: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, absolute: float, relative: float) -> DataFrame:
    """|a - b| <= absolute + relative * |b| for each key: matched, mismatch or unavailable."""
    a = primary.select(*keys, F.col(value).alias("primary_value"))
    b = reference.select(*keys, F.col(value).alias("reference_value"))
    gap = F.col("primary_value").isNull() | F.col("reference_value").isNull()
    near = F.abs(F.col("primary_value") - F.col("reference_value")) <= absolute + relative * F.abs("reference_value")
    return a.join(b, list(keys), "full").select(*keys, "primary_value", "reference_value", F.when(gap, "unavailable").when(near, "matched").otherwise("mismatch").alias("outcome"))


def walk_forward(samples: DataFrame, study: Sequence[str], train_size: int, test_size: int, purge: int, embargo: int, min_train: int) -> DataFrame:
    """Expanding, purged and embargoed folds over session indices. samples: study, sample_id, session_index,
    label_end_session_index, available. Rows (fold, sample, role); a study with index gaps, several label lengths or a too
    small training set in any fold is unavailable as a whole (one row with its reason)."""
    w = Window.partitionBy(*study)
    first = F.min("session_index").over(w)
    rows = samples.select(*study, "sample_id", "available", (F.col("session_index") - first).alias("i"), (F.col("label_end_session_index") - first).alias("end"))
    shape = rows.groupBy(*study).agg((F.max("i") + 1).alias("n"), F.count_distinct("i").alias("distinct_i"), F.count_distinct(F.col("end") - F.col("i")).alias("spans"))
    folds = shape.where(F.col("n") >= train_size + test_size).select(*study, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train_size - test_size) / (test_size + embargo)).cast("int"))).alias("fold"))
    folds = folds.withColumn("test_start", F.lit(train_size) + F.col("fold") * (test_size + embargo))
    cutoff, stop = F.col("test_start") - purge, F.col("test_start") + test_size
    role = F.when((F.col("i") >= F.col("test_start")) & (F.col("i") < stop), "test").when((F.col("i") >= stop) & (F.col("i") < stop + embargo), "embargo").when((F.col("i") < F.col("test_start")) & (F.col("end") < cutoff), "train").when(F.col("i") < F.col("test_start"), "purged")
    placed = folds.join(rows.where("available"), list(study)).select(*study, "fold", "sample_id", role.alias("role")).where("role is not null")
    least = placed.groupBy(*study, "fold").agg(F.count_if(F.col("role") == "train").alias("n")).groupBy(*study).agg(F.min("n").alias("least_train"))
    verdict = shape.join(least, list(study), "left").select(*study, F.when(F.col("distinct_i") != F.col("n"), "sessions_not_contiguous").when(F.col("spans") > 1, "mixed_label_horizons").when(F.col("least_train").isNull(), "insufficient_sessions").when(F.col("least_train") < min_train, "insufficient_training_samples").alias("unavailable_reason"))
    return verdict.join(placed, list(study), "left").where(F.col("unavailable_reason").isNull()).unionByName(verdict.where("unavailable_reason is not null"), allowMissingColumns=True)


def calendar_split(df: DataFrame, date: str, validation_from: str, test_from: str, end: str) -> DataFrame:
    """Frozen split at dates, half-open; rows from ``end`` on have no role."""
    d = F.col(date)
    return df.withColumn("role", F.when(d < F.lit(validation_from).cast("date"), "train").when(d < F.lit(test_from).cast("date"), "validation").when(d < F.lit(end).cast("date"), "test"))


