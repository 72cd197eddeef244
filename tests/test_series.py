"""Lags, returns, samples and diagnostics, mostly with blocks of a few rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.distributions import chi2_tail, normal_tail, t_value, z_value
from seriesmill.operators.blocks import Blocking, fitted_blocking, lagged, pack
from seriesmill.operators.derive import (
    cc_returns, frac_diff, frac_weights, holdout, series_tail, train_holdout_split,
)
from seriesmill.operators.diagnostics import (
    accuracy_measures, acf, diff_distribution, diff_ecdf, fd_histogram, ljung_box, sd_band,
)
from seriesmill.operators.moments import gram, lag_products

K = ["series"]
RNG = np.random.default_rng(7)
WALK = RNG.normal(50, 10, 83).round(2)
GAPS = np.cumsum(RNG.integers(1, 9, 83))
CUTS = [Blocking(1000), Blocking(10), Blocking(1)]


def table(df, *columns):
    return {tuple(r[c] for c in columns): r for r in df.collect()}


@pytest.mark.parametrize("cut", CUTS)
def test_lags_cross_blocks_and_gaps(make, cut):
    df = make({"a": WALK, "b": WALK[:3]}, {"a": GAPS, "b": GAPS})
    rows = lagged(df, K, "t", "x", 5, cut).collect()
    assert len(rows) == 86
    for r in rows:
        assert r.n == (83 if r.series == "a" else 3)
        assert r.x == WALK[r.pos - 1]
        for k in range(1, 6):
            assert r[f"x_{k}"] == (WALK[r.pos - 1 - k] if r.pos > k else None)


def test_blocking_measured_on_dense_times(spark):
    seconds = spark.range(900).select(
        F.lit("a").alias("series"), F.col("id").cast("double").alias("x"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"))
    fitted = fitted_blocking(seconds, K, "ts", 100)
    sizes = [len(r.obs) for r in pack(seconds, K, "ts", ["x"], fitted).collect()]
    assert sum(sizes) == 900 and max(sizes) <= 100
    assert fitted_blocking(seconds.where("x < 50"), K, "ts", 100) == Blocking(100, 3600.0)


def test_a_repeated_time_stops_the_job(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "series string, t int, x double")
    with pytest.raises(Exception, match="share a time"):
        lagged(df, K, "t", "x", 1).collect()


def test_missing_values_are_not_observations(make):
    df = make({"a": [1.0, None, 2.0, float("nan"), 4.0]})
    assert [r.x_1 for r in lagged(df, K, "t", "x", 1).orderBy("t").collect()] == [None, 1.0, 2.0]


def test_empty_input(make):
    df = make({"a": [1.0]}).where("t > 5")
    assert ljung_box(df, K, "t", "x").count() == 0
    assert fd_histogram(df, K, "t", "x").count() == 0
    assert acf(df, K, "t", "x").count() == 0
    assert series_tail(df, K, "t", "x").count() == 0


def test_returns(make):
    df = make({"a": [1.0, math.e, -1.0, 2.0, 4.0]})
    got = [r.ret for r in cc_returns(df, K, "t", "x", Blocking(2)).orderBy("t").collect()]
    assert got[0] == pytest.approx(1.0)
    assert got[1:3] == [None, None]
    assert got[3] == pytest.approx(math.log(2))


def test_tail_and_samples(make):
    df = make({"a": range(1, 13), "b": [5.0, 6.0]})
    tail = series_tail(df, K, "t", "x", 10)
    assert [(r.pos, r.x) for r in tail.where("series='a'").orderBy("pos").collect()] == [
        (i, float(i + 2)) for i in range(1, 11)]
    assert [(r.pos, r.x) for r in tail.where("series='b'").orderBy("pos").collect()] == [
        (1, 5.0), (2, 6.0)]
    split = train_holdout_split(df, K, "t", "x", 3, Blocking(4))
    assert split.count() == 14
    held = {(r.series, r.h): r.x for r in split.where("sample='holdout'").collect()}
    assert held == {("a", 1): 10.0, ("a", 2): 11.0, ("a", 3): 12.0, ("b", 1): 5.0, ("b", 2): 6.0}
    assert held == {(r.series, r.h): r.actual for r in holdout(df, K, "t", "x", 3).collect()}
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fractional_difference(make):
    weights = frac_weights(0.4, 6)
    want = [sum(weights[k] * WALK[i - k] for k in range(min(i, 6) + 1)) for i in range(83)]
    got = frac_diff(make({"a": WALK}), K, "t", "x", 0.4, 6, Blocking(9)).orderBy("t").collect()
    assert np.allclose([r.fd for r in got], want)
    assert frac_weights(1.0, 3) == [1.0, -1.0, 0.0, 0.0]


def rho(x, k):
    z = np.asarray(x, float) - np.mean(x)
    return (z[k:] @ z[:-k]) / (z @ z)


def test_six_rows_by_hand(make):
    # z = -2.5 … 2.5: denominators 17.5, lag-1 products 8.75
    df = make({"a": [1, 2, 3, 4, 5, 6]})
    first = table(acf(df, K, "t", "x", 2), "lag")
    assert first[1,].rho == pytest.approx(8.75 / 17.5)
    assert first[1,].limit == pytest.approx(1.959963984540054 / math.sqrt(6))
    test = ljung_box(df, K, "t", "x", 2, 0).first()
    want = 6 * 8 * (rho(range(6), 1) ** 2 / 5 + rho(range(6), 2) ** 2 / 4)
    assert test.q == pytest.approx(want)
    assert test.p_value == pytest.approx(math.exp(-want / 2))


@pytest.mark.parametrize("cut", CUTS)
def test_acf_default_lags_and_invariance(make, cut):
    got = table(acf(make({"a": WALK, "b": 3 * WALK + 1000}), K, "t", "x", blocking=cut),
                "series", "lag")
    last = math.floor(10 * math.log10(83))
    assert len(got) == 2 * last
    for k in range(1, last + 1):
        assert got["a", k].rho == pytest.approx(rho(WALK, k), abs=1e-12)
        assert got["b", k].rho == pytest.approx(rho(WALK, k), abs=1e-10)


def test_constant_and_short_series(make):
    df = make({"flat": [0.1] * 30, "short": [1.0, 2.0, 4.0]})
    box = table(ljung_box(df, K, "t", "x", 10, 6), "series")
    assert box["flat",].q is None and box["short",].q is None
    rows = table(acf(df, K, "t", "x", 5), "series", "lag")
    assert rows["flat", 1].rho is None
    assert {k for k in rows if k[0] == "short"} == {("short", 1), ("short", 2)}
    bars = table(fd_histogram(df.where("series='flat'"), K, "t", "x"), "bin")
    assert len(bars) == 1 and bars[1,].n == 30
    with pytest.raises(ValueError):
        ljung_box(df, K, "t", "x", 4, 4)


def test_histogram_by_hand(make):
    # quartiles 3.25 and 7.75, width 9/10^(1/3) = 4.18, 3 bins of 3: edges 1, 4, 7, 10
    df = make({"a": range(1, 11)})
    bars = [(r.bin, r.lo, r.hi, r.n) for r in fd_histogram(df, K, "t", "x").orderBy("bin").collect()]
    assert bars == [(1, 1.0, 4.0, 4), (2, 4.0, 7.0, 3), (3, 7.0, 10.0, 3)]


def test_histogram_without_quartile_spread_and_with_empty_bins(make):
    df = make({"a": [0.0] * 30 + [10.0] + [0.0]})
    bars = fd_histogram(df, K, "t", "x").orderBy("bin").collect()
    assert len(bars) == 6 and [r.n for r in bars] == [31, 0, 0, 0, 0, 1]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_match_numpy_also_through_narrow_brackets(make, accuracy):
    from seriesmill.operators.quantiles import exact_quantiles
    heavy = np.concatenate([RNG.normal(size=3000) ** 3, np.zeros(1500)])
    values = make({"a": heavy, "b": WALK}).select(*K, F.col("x").alias("v"))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = table(exact_quantiles(values, K, probs, accuracy), "series")
    assert np.allclose(got["a",].q, np.quantile(heavy, probs), atol=0, rtol=1e-12)
    assert np.allclose(got["b",].q, np.quantile(WALK, probs))
    assert got["a",].n == 4500 and got["a",].max == heavy.max()


def test_distribution_and_ecdf(make):
    df = make({"a": WALK.tolist() + [WALK[0]] * 5}).withColumnRenamed("x", "diff")
    values = np.append(WALK, [WALK[0]] * 5)
    d = diff_distribution(df, K, "t").first()
    z = values - values.mean()
    assert d.sd == pytest.approx(values.std(ddof=1))
    assert d.skewness == pytest.approx((z**3).mean() / (z**2).mean() ** 1.5)
    assert d.kurtosis == pytest.approx((z**4).mean() / (z**2).mean() ** 2 - 3)
    steps = diff_ecdf(df, K, "t").orderBy("value").collect()
    distinct, counts = np.unique(values, return_counts=True)
    assert [r.value for r in steps] == distinct.tolist()
    assert [r.cum for r in steps] == counts.cumsum().tolist()
    assert steps[-1].ecdf == 1.0


def test_band(make):
    b = sd_band(make({"a": WALK}), K, "t", "x", 2).first()
    assert b.upper == pytest.approx(WALK.mean() + 2 * WALK.std(ddof=1))


def test_accuracy(spark):
    x, fitted = [2.0, 4.0, 8.0, 4.0], [None, 3.0, 9.0, 4.5]
    df = spark.createDataFrame(
        [("a", i, v, None if f is None else v - f) for i, (v, f) in enumerate(zip(x, fitted))],
        "series string, t int, x double, resid double")
    r = np.array([1.0, -1.0, -0.5])
    a = accuracy_measures(df, K, "t", blocking=Blocking(2)).first()
    assert a.me == pytest.approx(r.mean()) and a.rmse == pytest.approx(math.sqrt((r**2).mean()))
    assert a.mape == pytest.approx(np.mean(np.abs(100 * r / np.array([4, 8, 4]))))
    assert a.mase == pytest.approx(np.abs(r).mean() / np.mean([2, 4, 4]))
    assert a.acf1 == pytest.approx(rho(r, 1))


@pytest.mark.parametrize("raw", [True, False])
def test_cross_products_over_any_range(make, raw):
    products = lag_products(make({"a": WALK}), K, "t", "x", 6, Blocking(10), edges=True)
    got = products.select(F.expr(gram("4", 6, "5", str(raw).lower())).alias("g")).first().g
    y = WALK if raw else WALK - WALK.mean()
    lags = np.array([y[5 - i:83 - i] for i in range(5)])
    assert np.allclose(np.array(got), lags @ lags.T)


def test_tails_and_quantiles(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(chi2_tail(F.lit(10.334260729675043), 4)) == pytest.approx(0.0351582236, abs=1e-9)
    # 95 % points of chi-square from printed tables
    for df, point in {1: 3.841458821, 2: 5.991464547, 3: 7.814727903, 5: 11.07049769,
                      7: 14.06714045, 9: 16.9189776}.items():
        assert value(chi2_tail(F.lit(point), df)) == pytest.approx(0.05, abs=1e-8)
    for z in (0.0, 0.5, 1.96, 2.99, 3.01, 5.0, 9.0):
        assert value(normal_tail(F.lit(z))) == pytest.approx(
            0.5 * math.erfc(z / math.sqrt(2)), rel=1e-10)
    assert z_value(0.95) == pytest.approx(1.959963984540054)
    # 97.5 % points of Student's t from printed tables
    for df, point in {1: 12.7062047, 2: 4.30265273, 3: 3.18244631, 4: 2.77644511, 5: 2.57058184,
                      10: 2.22813885, 29: 2.04522964, 30: 2.04227246, 100: 1.98397152}.items():
        assert value(t_value(0.95, F.lit(float(df)))) == pytest.approx(point, abs=2e-7)
    assert value(t_value(0.95, F.lit(0.0))) is None


def test_a_large_group_is_ranked_in_several_pieces(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 20_000, 60_000) / 8, np.full(30_000, 99.5)])
    df = spark.createDataFrame(
        [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 1, 2.0)], "series string, t int, diff double")
    got = diff_ecdf(df, K, "t").where("series = 'a'").orderBy("value").collect()
    distinct, counts = np.unique(x, return_counts=True)
    assert [r.value for r in got] == distinct.tolist()
    assert [r.cum for r in got] == counts.cumsum().tolist()
    assert got[-1].ecdf == 1.0


def test_a_far_value_does_not_widen_bins(make):
    df = make({"a": [*np.linspace(0, 1, 999), 1e9]})
    with pytest.raises(Exception, match="max_bins"):
        fd_histogram(df, K, "t", "x").collect()
    bars = fd_histogram(df, K, "t", "x", max_bins=None).orderBy("bin").collect()
    assert sum(r.n for r in bars) == 1000
    assert len(bars) > 5 and bars[0].hi - bars[0].lo < 0.2


def test_rows_at_one_time_stop_the_tail(make):
    df = make({"a": [1, 2, 3, 4]}, {"a": [1, 2, 3, 3]})
    with pytest.raises(Exception, match="share a time"):
        series_tail(df, K, "t", "x", 1).collect()
    with pytest.raises(Exception, match="share a time"):
        holdout(df, K, "t", "x", 3).collect()
    assert series_tail(make({"a": [1, 2, 3]}), K, "t", "x", 2).count() == 2


def test_lags_beyond_the_halo_stop_the_job(make):
    from seriesmill.operators.moments import lag_products_to
    with pytest.raises(Exception, match="lags beyond 3"):
        lag_products_to(make({"a": WALK}), K, "t", "x", F.lit(4), 3).collect()


@pytest.mark.parametrize("seconds", [0.001, 1, 3600, 86_400, 604_800])
def test_blocks_fit_any_spacing(spark, seconds):
    from datetime import datetime, timedelta

    start = datetime(2020, 1, 1)
    times = [("a", start + timedelta(seconds=seconds * i), float(i)) for i in range(3000)]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(times, "series string, t timestamp, x double")
        df = df.withColumn("t", F.col("t").cast(kind))
        fitted = fitted_blocking(df, K, "t", 100)
        sizes = [r.s for r in pack(df, K, "t", ["x"], fitted).select(F.size("obs").alias("s")).collect()]
        assert sum(sizes) == 3000
        assert max(sizes) <= 100
        assert len(sizes) <= 2 * 3000 / 100 + 2


def test_blocks_that_cannot_fit(spark):
    df = spark.createDataFrame([("a", 1, 1.0)] * 20, "series string, t int, x double")
    with pytest.raises(ValueError, match="share one unit"):
        fitted_blocking(df, K, "t", 10)
    assert fitted_blocking(df.limit(0), K, "t", 10).rows == 10


# ---- lags by transform, quantiles in rounds, weekly updates ------------------------------------------

@pytest.mark.parametrize("own, before, last, direct", [
    (500, 130, 130, 0), (500, 130, 130, 1 << 20), (1, 0, 0, 0), (7, 3, 40, 0), (7, 3, 40, 1 << 20), (64, 64, 63, 0)])
def test_correlations_of_a_block(own, before, last, direct):
    from seriesmill.operators.moments import correlations
    draw = np.random.default_rng(own)
    values = draw.normal(size=before + own) * 1e3
    values[:before // 3] = np.nan
    z = np.nan_to_num(values)
    want = [sum(z[i] * z[i - k] for i in range(before, before + own) if i >= k) for k in range(last + 1)]
    assert np.allclose(correlations(values, own, last, direct), want, rtol=0, atol=1e-9 * float(z @ z))


@pytest.mark.parametrize("held, accuracy", [(5, 100), (50, 1000), (400, 10_000)])
def test_brackets_are_narrowed_until_few_rows_are_left(make, held, accuracy):
    from seriesmill.operators.quantiles import exact_quantiles
    groups = {
        "spread": RNG.normal(size=5000) ** 5, "heavy": np.concatenate([RNG.normal(size=1500), np.full(2500, 0.25), np.full(900, 3.0)]),
        "two": np.array([1.0] * 1700 + [2.0] * 1300), "one": np.full(2000, -7.0), "few": np.array([3.0, 1.0, 2.0]),
        "far": np.concatenate([[-1e300, 1e300], RNG.normal(size=3000)])}
    values = make({k: v.tolist() for k, v in groups.items()}).select(*K, F.col("x").alias("v"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = table(exact_quantiles(values, K, probs, accuracy, held=held), "series")
    for k, v in groups.items():
        assert np.allclose(got[k,].q, np.quantile(v, probs), atol=0, rtol=1e-12), k
        assert got[k,].n == len(v)


def test_only_touched_weeks_are_written(spark, tmp_path):
    import os
    from datetime import date, datetime

    from seriesmill.sources.tables import read_prepared, touched_weeks, update_prepared

    def rows(day, price):
        return (datetime(2024, 1, day, 5), date(2024, 1, day - (day + 1) % 7) if day > 6 else date(2023, 12, 30), price)

    schema, path = "ts timestamp_ntz, op_week date, price double", str(tmp_path / "prepared")
    first = [rows(3, 1.0), rows(8, 2.0), rows(15, 3.0)]
    all_weeks = spark.createDataFrame(first, schema)
    update_prepared(all_weeks, path, all_weeks.select("op_week"))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}

    before = files()
    # a price published late, on a Friday, counts for the week from the next day
    weekly = spark.createDataFrame([(date(2024, 1, 5),)], "pub_date date")
    weeks = touched_weeks(all_weeks.limit(0), weekly)
    assert [r["op_week"] for r in weeks.collect()] == [date(2024, 1, 6)]
    later = spark.createDataFrame([rows(3, 9.0), rows(8, 9.0), rows(15, 9.0)], schema)
    for _ in range(2):
        update_prepared(later, path, weeks)
        found = {r["op_week"]: r["price"] for r in read_prepared(spark, path).collect()}
        assert found == {date(2023, 12, 30): 1.0, date(2024, 1, 6): 9.0, date(2024, 1, 13): 3.0}
    assert {f for f in before if "2024-01-06" not in f} <= files() and not {f for f in before if "2024-01-06" in f} & files()
    hours = spark.createDataFrame([rows(15, 1.0)], schema)
    assert [r["op_week"] for r in touched_weeks(hours, weekly.limit(0)).collect()] == [date(2024, 1, 13)]


@pytest.mark.parametrize("d, lags", [(0.3, 3000), (-0.4, 700), (0.00943, 5000), (1.0, 2000), (2.5, 4999)])
def test_long_memory(make, d, lags):
    from seriesmill.operators.derive import frac_weights
    series = {"a": RNG.normal(size=5000), "b": RNG.normal(size=90), "c": [2.0]}
    got = table(frac_diff(make({k: list(v) for k, v in series.items()}), K, "t", "x", d, lags, Blocking(rows=64)), "series", "t")
    weights = np.array(frac_weights(d, lags))
    for k, v in series.items():
        want = np.convolve(v, weights)[:len(v)]
        assert np.allclose([got[k, i + 1].fd for i in range(len(v))], want, rtol=0, atol=1e-9)


@pytest.mark.parametrize("d", [0.3, -0.4, 1.7, 2.0])
def test_weights_far_back(d):
    from seriesmill.operators.derive import FAR, weights_between
    k = np.arange(1, 3 * FAR, dtype=float)
    plain = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
    far = weights_between(d, 2 * FAR, 2 * FAR + 50, 10 * FAR)
    assert np.allclose(far, plain[2 * FAR:2 * FAR + 51], rtol=1e-9, atol=0)
    assert np.allclose(weights_between(d, -3, 4, 2), [0, 0, 0, *plain[:3], 0, 0])


def test_operators_from_sql(spark, make):
    from seriesmill.sources.views import analysis_views
    df = make({"a": WALK.tolist(), "b": WALK[:50].tolist()})
    df.createOrReplaceTempView("walks")
    names = analysis_views(spark, "walks", K, "t", "x", d=0.3, cut=20)
    assert names == [f"walks_{n}" for n in ("lagged", "returns", "tail", "acf", "ljung_box", "band", "histogram", "frac_diff")]
    found = spark.sql("SELECT series, max(pos) AS n, sum(x - x_1) AS moved FROM walks_lagged GROUP BY series ORDER BY series")
    assert [(r.series, r.n) for r in found.collect()] == [("a", len(WALK)), ("b", 50)]
    joined = spark.sql("SELECT count(*) AS n FROM walks_acf JOIN walks_band USING (series) WHERE lag <= 5").first()
    assert joined.n == 10
    for name in names:
        assert spark.table(name).count() > 0 or name.endswith("returns")
