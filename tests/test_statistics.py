"""Hand numbers and unavailable reasons of statistics, transforms, labels and volatility."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import numpy as np
import pytest

from asofspark.operators import stats, transforms


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ic_hand_case_and_reasons(spark):
    data = [("a", s, f) for s, f in zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 3.0, 2.0, 5.0, 4.0], strict=True)]
    data += [("flat", 1.0, x) for x in (1.0, 2.0, 3.0)] + [("few", 1.0, 2.0), ("few", None, 1.0)]
    df = spark.createDataFrame(data, "p string, s double, f double")
    got = {r["p"]: r for r in stats.ic(df, ["p"], "s", "f").collect()}
    assert got["a"]["value"] == pytest.approx(0.8) and got["a"]["n_obs"] == 5
    assert got["flat"]["unavailable_reason"] == "zero_variance" and got["flat"]["value"] is None
    assert got["few"]["unavailable_reason"] == "insufficient_observations" and got["few"]["n_missing"] == 1
    shuffled = {r["p"]: r["value"] for r in stats.ic(df.repartition(7), ["p"], "s", "f").collect()}
    assert shuffled["a"] == pytest.approx(got["a"]["value"], abs=1e-12)


def test_rank_ic_with_ties(spark):
    x, y = [1.0, 1.0, 2.0, 3.0, 3.0, 9.0], [2.0, 1.0, 4.0, 4.0, 5.0, 6.0]
    rank = lambda v: [np.mean([i + 1 for i, z in enumerate(sorted(v)) if z == a]) for a in v]
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    df = spark.createDataFrame([("p", a, b) for a, b in zip(x, y, strict=True)], "p string, s double, f double")
    assert stats.ic(df, ["p"], "s", "f", "spearman").first()["value"] == pytest.approx(want)


def test_quantile_buckets_follow_floor_rule(spark):
    df = spark.createDataFrame([("p", k, float(k), k / 10) for k in range(10)], "p string, e int, s double, f double")
    got = stats.quantile_portfolios(df, ["p"], "s", "f", "e", 4, 4).orderBy("bucket").collect()
    assert [r["n_bucket"] for r in got] == [3, 2, 3, 2]
    assert got[0]["value"] == pytest.approx(0.85 - 0.1) and got[0]["monotonicity"] == 1.0
    assert stats.quantile_portfolios(df, ["p"], "s", "f", "e", 4, 11).first()["unavailable_reason"] == "insufficient_observations"


def test_turnover_and_reasons(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.2), (2, "c", 0.8), (3, "a", None), (3, "b", 1.0), (4, "a", 0.4)], "p int, e string, w double")
    got = {(r["from_period"], r["to_period"]): r for r in stats.turnover(df, "p", "e", "w").collect()}
    assert got[1, 2]["value"] == pytest.approx(0.8)
    assert got[2, 3]["unavailable_reason"] == "missing_weight"
    assert got[3, 4]["status"] == "unavailable"


def test_decay(spark):
    df = spark.createDataFrame([("a", 1, 0.4), ("a", 3, 0.3), ("a", 6, -0.1), ("z", 1, 0.0), ("z", 3, 0.2), ("one", 1, 0.5)], "s string, h int, c double")
    got = {(r["s"], r["horizon"]): r for r in stats.decay(df, ["s"], "h", "c").collect()}
    assert got["a", 6]["strength"] == pytest.approx(0.25) and got["a", 1]["value"] == 6.0
    assert got["z", 1]["unavailable_reason"] == "zero_initial_correlation" and got["one", 1]["unavailable_reason"] == "insufficient_horizons"


@pytest.mark.parametrize("k", [1, 2, 3])
def test_fama_macbeth_against_least_squares(spark, k):
    rng = np.random.default_rng(2)
    data, betas = [], []
    for p in range(6):
        x = rng.normal(size=(12, 3))
        y = 0.1 + x @ [0.5, -0.2, 0.3] + rng.normal(0, 0.05, 12)
        betas.append(np.linalg.lstsq(np.column_stack([np.ones(12), x[:, :k]]), y, rcond=None)[0][1:])
        data += [(p, *map(float, v), float(r)) for v, r in zip(x, y, strict=True)]
    data += [(99, 1.0, 1.0, 1.0, float(v)) for v in range(8)]  # rank-deficient
    df = spark.createDataFrame(data, "p int, f0 double, f1 double, f2 double, y double")
    got = {r["factor"]: r for r in stats.fama_macbeth(df, "p", "y", [f"f{i}" for i in range(k)]).collect()}
    for i in range(k):
        b = np.array(betas)[:, i]
        assert got[f"f{i}"]["value"] == pytest.approx(b.mean()) and got[f"f{i}"]["standard_error"] == pytest.approx(b.std(ddof=1) / math.sqrt(6))
        assert got[f"f{i}"]["n_excluded"] == 1


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(p)] + [("gap", 1, None), ("gap", 2, 0.1)], "f string, h int, p double")
    got = {(r["f"], r["h"]): r for r in stats.benjamini_hochberg(df, ["f"], "h", "p", 0.05).collect()}
    assert [got["f", k]["rejected"] for k in range(5)] == [True, True, True, True, False]
    assert got["f", 0]["value"] == pytest.approx(0.025) and got["f", 2]["value"] == pytest.approx(0.05)
    assert got["gap", 2]["unavailable_reason"] == "missing_p_value"


def test_newey_west_against_numpy(spark):
    v = [0.1, 0.3, -0.2, 0.4, 0.15, 0.05, 0.2]
    e = np.array(v) - np.mean(v)
    n = len(v)
    lrv = sum(e * e) / n + 2 * (0.5 * sum(e[1:] * e[:-1]) / n)
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(v)] + [("gap", 0, None)], "s string, k int, v double")
    got = {r["s"]: r for r in stats.newey_west(df, ["s"], "k", "v", 1).collect()}
    assert got["s"]["standard_error"] == pytest.approx(math.sqrt(lrv / n)) and got["gap"]["unavailable_reason"] == "missing_value"


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    df = spark.createDataFrame([("s", k, math.sin(k) + 0.3) for k in range(60)] + [("short", 0, 1.0)], "s string, k int, v double")
    once = {r["s"]: r for r in stats.block_bootstrap(df, ["s"], "k", "v", 5, 200).collect()}
    again = {r["s"]: r for r in stats.block_bootstrap(df.repartition(9), ["s"], "k", "v", 5, 200).collect()}
    assert once["s"]["lower"] < once["s"]["value"] < once["s"]["upper"] and once["s"]["lower"] == pytest.approx(again["s"]["lower"])
    assert once["short"]["unavailable_reason"] == "block_longer_than_series"


def test_walk_forward_purges_and_fails_closed(spark):
    s = [("a", f"s{k}", k, k + 2, True) for k in range(30)] + [("gap", f"s{k}", k, k + 2, True) for k in range(30) if k != 4]
    df = spark.createDataFrame(s, "study string, sample_id string, session_index int, label_end_session_index int, available boolean")
    got = stats.walk_forward(df, ["study"], 12, 5, 1, 2, 3).collect()
    fold0 = {r["sample_id"]: r["role"] for r in got if r["study"] == "a" and r["fold"] == 0}
    assert fold0["s8"] == "train" and fold0["s9"] == "purged" and fold0["s12"] == "test" and fold0["s17"] == "embargo" and "s19" not in fold0
    assert [r["unavailable_reason"] for r in got if r["study"] == "gap"] == ["sessions_not_contiguous"]


def test_winsorize_zscore_neutralize(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("p", k, x) for k, x in enumerate(v)] + [("p", 9, None)], "p string, k int, v double")
    w = {r["k"]: r for r in transforms.winsorize(df, ["p"], "v", 0.25, 0.75).collect()}
    assert [w[k]["value"] for k in range(5)] == [2.0, 2.0, 3.0, 4.0, 4.0] and w[9]["unavailable_reason"] == "missing_value"
    z = {r["k"]: r["value"] for r in transforms.zscore(df, ["p"], "v", 1).collect()}
    assert z[4] == pytest.approx((100 - 22) / statistics.stdev(v))
    flat = spark.createDataFrame([("p", k, 3.0) for k in range(4)], "p string, k int, v double")
    assert transforms.zscore(flat, ["p"], "v").first()["unavailable_reason"] == "zero_variance"
    with pytest.raises(ValueError):
        transforms.winsorize(df, ["p"], "v", 0.8, 0.2)


def test_neutralize_against_dummies(spark):
    rng = np.random.default_rng(4)
    n = 40
    ind, size, y = rng.integers(0, 4, n), rng.normal(size=n), rng.normal(size=n)
    x = np.column_stack([np.ones(n), *[(ind == k).astype(float) for k in range(1, 4)], size])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    df = spark.createDataFrame([("p", k, float(y[k]), int(ind[k]), float(size[k])) for k in range(n)] + [("p", 99, 1.0, None, 1.0)], "p string, k int, v double, i int, s double")
    got = {r["k"]: r for r in transforms.neutralize(df, ["p"], "v", "i", "s").collect()}
    assert all(got[k]["value"] == pytest.approx(want[k], abs=1e-9) for k in range(n)) and got[99]["unavailable_reason"] == "missing_industry"


def test_forward_return_reasons(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    p = [(1, day(k), 10.0 + k, k != 3) for k in range(8)] + [(2, day(0), 0.0, True), (2, day(1), 5.0, True), (2, day(2), 6.0, True)]
    df = spark.createDataFrame(p, "listing_id int, session_date date, close double, tradable boolean")
    ask = spark.createDataFrame([(1, day(k)) for k in range(8)] + [(1, day(40)), (2, day(0))], "listing_id int, session_date date")
    got = {(r["listing_id"], r["session_date"]): r for r in transforms.forward_return(df, 2, ask).collect()}
    assert got[1, day(0)]["value"] == pytest.approx(0.2) and got[1, day(2)]["value"] == pytest.approx(2 / 12)  # suspension inside is fine
    assert got[1, day(1)]["unavailable_reason"] == got[1, day(3)]["unavailable_reason"] == "not_tradable"
    assert got[1, day(7)]["unavailable_reason"] == "horizon_incomplete" and got[1, day(40)]["unavailable_reason"] == "decision_session_missing"
    assert got[2, day(0)]["unavailable_reason"] == "invalid_price"


def test_volatility_hand_number(spark):
    df = spark.createDataFrame([("b", k, 100.0 + k * k) for k in range(21)], "b string, k int, c double")
    vol = transforms.passive_volatility(df, "b", "k", "c")
    got = {r["k"]: r for r in transforms.exposure(vol, 0.1, 1.0).collect()}
    assert got[20]["value"] == pytest.approx(0.389123026681563) and got[20]["exposure"] == pytest.approx(0.1 / 0.389123026681563)
    assert got[19]["exposure"] is None and got[19]["exposure_reason"] == "insufficient_history"
