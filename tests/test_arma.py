"""Models against plain numpy loops, in one block and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import arma, recursion
from seriesmill.operators.arma import (
    Arma, arma_evaluate, arma_fit_css, arma_fit_hr, arma_residuals, coef_table,
    order_leaderboard, order_search,
)
from seriesmill.operators.blocks import Blocking
from seriesmill.operators.derive import holdout, train_holdout_split
from seriesmill.operators.forecast import arma_forecast, forecast_chart_frame, forecast_vs_actual
from seriesmill.plans.lifecycle import analyse

K = ["series"]
PHI, THETA = [0.5, -0.2, 0.1], [0.6]


def simulate(n, phi, theta, seed, scale=2.0):
    e = np.random.default_rng(seed).normal(scale=scale, size=n + 100)
    x = np.zeros(n + 100)
    for t in range(n + 100):
        x[t] = e[t] + sum(c * x[t - 1 - i] for i, c in enumerate(phi) if t > i)
        x[t] += sum(c * e[t - 1 - i] for i, c in enumerate(theta) if t > i)
    return x[100:]


SERIES = {"a": simulate(400, PHI, THETA, 1), "b": simulate(400, PHI, THETA, 2)}


def shocks(x, phi, theta, drop):
    """Residuals and their derivatives, one step at a time."""
    p, q = len(phi), len(theta)
    e, d = np.zeros(len(x)), np.zeros((len(x), p + q))
    for t in range(drop, len(x)):
        e[t] = x[t] - sum(phi[i] * x[t - 1 - i] for i in range(p))
        for i in range(p):
            d[t, i] = -x[t - 1 - i]
        for j in range(min(q, t)):
            e[t] -= theta[j] * e[t - 1 - j]
            d[t, p + j] = -e[t - 1 - j]
        for j in range(min(q, t)):
            d[t] -= theta[j] * d[t - 1 - j]
    return e, d


def least_squares(x, p, q, start, rounds=60, drop=None):
    """Independent Gauss–Newton with halving on the plain loop, given the first ``drop`` values (p by default)."""
    drop = p if drop is None else drop
    b = np.array(start, float)
    e, d = shocks(x, b[:p], b[p:], drop)
    for _ in range(rounds):
        step = -np.linalg.lstsq(d, e, rcond=None)[0]
        for s in 0.5 ** np.arange(12):
            c = b + s * step
            e2, d2 = shocks(x, c[:p], c[p:], drop)
            if e2 @ e2 < e @ e:
                b, e, d = c, e2, d2
                break
        else:
            break
    return b, e @ e


CUTS = [Blocking(1000), Blocking(60)]


@pytest.mark.parametrize("cut", [Blocking(1000), Blocking(37), Blocking(2)])
def test_residuals(make, cut):
    rows = arma_residuals(make(SERIES), K, "t", "x", Arma(PHI, THETA), blocking=cut).orderBy("t")
    for name, x in SERIES.items():
        got = rows.where(F.col("series") == name).collect()
        want, _ = shocks(x, PHI, THETA, 3)
        assert [r.resid for r in got[:3]] == [None] * 3
        assert np.allclose([r.resid for r in got[3:]], want[3:])
        assert np.allclose([r.fitted + r.resid for r in got[3:]], x[3:])


@pytest.mark.parametrize("cut", CUTS)
def test_evaluation(make, cut):
    r = arma_evaluate(make({"a": SERIES["a"]}), K, "t", "x", Arma(PHI, THETA), blocking=cut).first()
    e, d = shocks(SERIES["a"], PHI, THETA, 3)
    sigma2 = (e @ e) / (397 - 4)
    assert r.sse == pytest.approx(e @ e) and r.sigma2 == pytest.approx(sigma2)
    assert np.allclose(np.array(r.vcov), sigma2 * np.linalg.inv(d.T @ d))
    loglik = -397 / 2 * (math.log(2 * math.pi * (e @ e) / 397) + 1)
    assert r.loglik == pytest.approx(loglik) and r.aic == pytest.approx(-2 * loglik + 10)
    assert r.aicc == pytest.approx(r.aic + 2 * 5 * 6 / (397 - 6))
    assert r.bic == pytest.approx(-2 * loglik + 5 * math.log(397))
    assert np.allclose(r.e_tail, [e[-1]])
    assert np.allclose(r.x_tail[:3], SERIES["a"][::-1][:3])


def test_a_model_table_deeper_than_announced_stops(make):
    df = make({"a": SERIES["a"]})
    model = arma_fit_hr(df, K, "t", "x", 3, 0)
    with pytest.raises(Exception, match="max_p = 2"):
        arma_residuals(df, K, "t", "x", model, max_p=2).collect()


def two_stage(x, p, q, mean=False):
    x = x - x.mean() if mean else x
    m = max(10, p + q + 5)
    skip = m + q if q else max(p, 5)
    t = np.arange(skip, len(x))
    columns = [x[t - i] for i in range(1, p + 1)]
    if q:
        long = np.linalg.lstsq(np.array([x[t - i] for i in range(1, m + 1)]).T, x[t], rcond=None)[0]
        e = np.full(len(x), np.nan)
        for s in range(m, len(x)):
            e[s] = x[s] - long @ x[s - m:s][::-1]
        columns += [e[t - j] for j in range(1, q + 1)]
    return np.linalg.lstsq(np.array(columns).T, x[t], rcond=None)[0]


@pytest.mark.parametrize("p,q,mean", [(3, 1, False), (2, 2, True), (0, 1, False), (4, 0, True)])
def test_two_stage_estimate(make, p, q, mean):
    shifted = {k: v + 5 for k, v in SERIES.items()} if mean else SERIES
    rows = arma_fit_hr(make(shifted), K, "t", "x", p, q, mean, Blocking(50)).collect()
    for r in rows:
        assert np.allclose(r.coef, two_stage(shifted[r.series], p, q, mean), atol=1e-8)


@pytest.mark.parametrize("cut", CUTS)
def test_least_squares(make, cut):
    rows = arma_fit_css(make(SERIES), K, "t", "x", 3, 1, blocking=cut).collect()
    assert len(rows) == 2
    for r in rows:
        want, sse = least_squares(SERIES[r.series], 3, 1, two_stage(SERIES[r.series], 3, 1))
        assert r.converged and r.sse == pytest.approx(sse, rel=1e-10)
        assert np.allclose(r.coef, want, atol=1e-5)
        # recovery: within four standard errors of the truth
        errors = np.sqrt(np.diag(np.array(r.vcov)))
        assert np.all(np.abs(np.array(r.coef) - [*PHI, *THETA]) < 4 * errors)


def test_weak_and_degenerate_series_do_not_stop_the_others(make):
    noise = np.random.default_rng(3).normal(size=200)
    df = make({"noise": noise, "flat": [1.0] * 60, "short": [1.0, 2.0], "good": SERIES["a"]})
    rows = {r.series: r for r in arma_fit_css(df, K, "t", "x", 3, 1, True).collect()}
    assert set(rows) == {"noise", "good"}
    assert all(np.isfinite(rows["noise"].coef)) and rows["good"].converged
    assert recursion.stable(rows["noise"].coef, 3, 1)


def test_stability_and_shrinking():
    assert recursion.stable([0.5, 0.3], 2, 0) and not recursion.stable([0.5, 0.6], 2, 0)
    assert recursion.stable([-1.5], 0, 1) is False
    for coef in ([2.0, -3.0, 1.0, 4.0], [np.nan, 1, 1, 1]):
        assert recursion.stable(recursion.steady(coef, 3, 1), 3, 1)


def test_coefficient_table(make):
    fit = arma_fit_css(make({"a": SERIES["a"]}), K, "t", "x", 3, 1)
    model, rows = fit.first(), coef_table(fit, K).collect()
    assert [r.term for r in rows] == ["AR1", "AR2", "AR3", "MA1"]
    for i, r in enumerate(rows):
        assert r.estimate == model.coef[i]
        assert r.t_value == pytest.approx(model.coef[i] / math.sqrt(model.vcov[i][i]))
        assert r.critical == pytest.approx(1.9659, abs=1e-3)  # 396 degrees of freedom
        assert r.significant == (abs(r.t_value) > r.critical)


@pytest.mark.parametrize("cut", CUTS)
def test_leaderboard_against_brute_force(make, cut):
    x = SERIES["a"][:150]
    board = order_leaderboard(
        make({"a": x}), K, "t", "x", 2, 2, 3, means=(False, True), blocking=cut).collect()
    assert len(board) == 2 * 8
    scores = []
    for r in board:
        y = x - x.mean() if r.with_mean else x
        if r.p + r.q:
            coef = two_stage(x, r.p, r.q, r.with_mean)
            coef = recursion.steady(coef, r.p, r.q) if r.q else coef
            assert np.allclose(r.coef, coef, atol=1e-8)
        e, _ = shocks(y, list(r.coef[:r.p]), list(r.coef[r.p:]), 5)
        assert r.sse == pytest.approx(e @ e)
        k = r.p + r.q + r.with_mean + 1
        aic = 145 * (math.log(2 * math.pi * (e @ e) / 145) + 1) + 2 * k
        assert r.aicc == pytest.approx(aic + 2 * k * (k + 1) / (145 - k - 1))
        scores.append((r.rank, r.aicc))
    assert [a for _, a in sorted(scores)] == sorted(a for _, a in scores)


def test_search_refines_the_winner(make):
    df = make({"ar": simulate(600, [0.7], [], 5), "ma": simulate(600, [], [0.8], 6)})
    board = {r.series: r for r in order_leaderboard(df, K, "t", "x", 2, 2, 3).where("rank=1").collect()}
    best = {r.series: r for r in order_search(df, K, "t", "x", 2, 2, 3).collect()}
    for name, r in best.items():
        assert (r.p, r.q, r.with_mean) == (board[name].p, board[name].q, board[name].with_mean)
        y = df.where(F.col("series") == name).orderBy("t").toPandas().x.to_numpy()
        y = y - y.mean() if r.with_mean else y
        # as the leaderboard, given the first five values
        _, sse = least_squares(y, r.p, r.q, board[name].coef, drop=5)
        assert r.sse == pytest.approx(sse, rel=1e-8)


def path(x, phi, theta, h):
    e, _ = shocks(x, phi, theta, len(phi))
    x, e, n = list(x), list(e), len(x)
    for _ in range(h):
        x.append(sum(c * x[-1 - i] for i, c in enumerate(phi))
                 + sum(c * e[-1 - j] for j, c in enumerate(theta)))
        e.append(0.0)
    psi = [1.0]
    for j in range(1, h):
        psi.append((theta[j - 1] if j <= len(theta) else 0.0)
                   + sum(phi[i] * psi[j - 1 - i] for i in range(min(j, len(phi)))))
    return x[n:], np.sqrt(np.cumsum(np.square(psi)))


@pytest.mark.parametrize("phi,theta", [(PHI, THETA), ([], [0.4, 0.2, -0.3]), ([0.9], [])])
def test_forecast(make, phi, theta):
    x = SERIES["a"]
    rows = arma_forecast(make({"a": x + 7}), K, "t", "x", Arma(phi, theta, 7.0), h=5,
                         blocking=Blocking(64)).orderBy("h").collect()
    mean, growth = path(x, phi, theta, 5)
    e, _ = shocks(x, phi, theta, len(phi))
    sigma = math.sqrt((e @ e) / (400 - len(phi) - len(phi) - len(theta) - 1))
    assert np.allclose([r.mean for r in rows], np.array(mean) + 7)
    assert np.allclose([r.se for r in rows], sigma * growth)
    widths = [r.upper - r.lower for r in rows]
    assert widths == sorted(widths)
    assert widths[0] == pytest.approx(2 * 1.959963984540054 * sigma)


def test_errors_and_chart(make):
    df = make({"a": SERIES["a"]})
    train = train_holdout_split(df, K, "t", "x").where("sample='train'").select("series", "t", "x")
    ahead = arma_forecast(train, K, "t", "x", Arma(PHI, THETA))
    actual = holdout(df, K, "t", "x")
    rows = forecast_vs_actual(ahead, actual, K).orderBy("h").collect()
    assert [r.actual for r in rows] == SERIES["a"][-3:].tolist()
    for r in rows:
        assert r.err == r.actual - r.pred and r.sq_err == r.err**2
    partial = forecast_vs_actual(ahead, actual.where("h < 3"), K).where("h = 3").first()
    assert partial.pred is not None and partial.err is None
    chart = forecast_chart_frame(train, ahead, actual, K, "t", "x").collect()
    labels = {}
    for r in chart:
        labels.setdefault(r.label, []).append(r.pos)
    assert sorted(labels.pop("history")) == list(range(1, 11))
    assert {k: sorted(v) for k, v in labels.items()} == {
        k: [11, 12, 13] for k in ("predicted", "lower", "upper", "actual")}


def test_whole_analysis(make):
    result = analyse(make(SERIES), K, "t", "x", blocking=Blocking(100))
    assert result["model"].count() == 2
    assert result["coefficients"].count() == 8
    assert result["ljung_box"].first().df == 6
    assert result["errors"].count() == 6
    bars = result["histogram"].groupBy("series").agg(F.sum("n").alias("n")).collect()
    assert [r.n for r in bars] == [394, 394]
    result["fitted"].unpersist()


def test_analysis_with_the_order_found(make):
    df = make({"ar": simulate(300, [0.7], [], 5), "ma": simulate(300, [], [0.8], 6)})
    with pytest.raises(ValueError, match="fit_df"):
        analyse(df, K, "t", "x", order="auto")
    result = analyse(df, K, "t", "x", order="auto", fit_df=2)
    models = {r.series: r for r in result["model"].collect()}
    fitted = result["fitted"].where("resid is not null").groupBy("series").agg(
        F.sum(F.col("resid") ** 2).alias("sse"), F.count("resid").alias("n")).collect()
    for r in fitted:
        assert r.sse == pytest.approx(models[r.series].sse) and r.n == models[r.series].n_used
    ahead = result["forecast"].where("h = 1").collect()
    assert {r.series for r in ahead} == {"ar", "ma"}
    for r in ahead:
        assert r.se == pytest.approx(math.sqrt(models[r.series].sigma2))
    result["fitted"].unpersist()


def test_a_search_beyond_five_lags(make):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    for i in range(7, 400):
        x[i] += 0.5 * x[i - 7]
    board = arma.order_leaderboard(make({"a": x}), K, "t", "x", max_p=7, max_q=0, max_order=None, means=(False,))
    got = {r.p: r.sse for r in board.collect()}
    for p in (1, 5, 7):
        lags = np.column_stack([x[7 - i:400 - i] for i in range(1, p + 1)])
        rest = x[7:] - lags @ np.linalg.lstsq(lags, x[7:], rcond=None)[0]
        assert got[p] == pytest.approx(rest @ rest, rel=1e-9)
    assert board.where("rank = 1").first().p == 7


# ---- reports merged in groups ------------------------------------------------------------------

@pytest.mark.parametrize("p, q", [(0, 0), (2, 0), (0, 3), (3, 1), (2, 2)])
@pytest.mark.parametrize("slopes", [True, False])
def test_merging_reports_is_associative(p, q, slopes):
    draw = np.random.default_rng(p + 10 * q)
    y, cuts = draw.normal(size=300), [0, 40, 41, 42, 150, 300]
    model = [p, q, 0.1, *draw.uniform(-0.3, 0.3, p + q)]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        before = min(a, 5)
        parts.append((np.concatenate([np.full(5 - before, np.nan), y[a - before:b]]), 5, max(p - a, 0), model))
    found = recursion.score(parts, slopes)
    left = recursion.merged(found, p, q, slopes)
    right = found[-1]
    for r in found[-2::-1]:
        right = recursion.merge(r, right, p, q, slopes)
    assert np.allclose(left, right)
    whole = recursion.score([(np.concatenate([np.full(5, np.nan), y]), 5, p, model)], slopes)
    for a, b in zip(recursion.chain([left], p, q, slopes)[::2], recursion.chain(whole, p, q, slopes)[::2]):
        assert np.allclose(a, b)


def test_thousands_of_blocks_are_one(make):
    series = {"long": simulate(12000, PHI, THETA, 3), "short": simulate(40, PHI, THETA, 4)}
    df, many, one = make(series), Blocking(rows=5, grain=1), Blocking(rows=20000, grain=1)
    model = Arma(tuple(PHI), tuple(THETA), mu=0.1)
    # 2400 blocks: three groups of 1024
    fine = {r["series"]: r for r in arma_evaluate(df, K, "t", "x", model, blocking=many).collect()}
    coarse = {r["series"]: r for r in arma_evaluate(df, K, "t", "x", model, blocking=one).collect()}
    for k in series:
        assert fine[k]["sse"] == pytest.approx(coarse[k]["sse"], rel=1e-10)
        assert np.allclose(fine[k]["vcov"], coarse[k]["vcov"])
        assert np.allclose(fine[k]["e_tail"], coarse[k]["e_tail"])
    resid = {b: {(r["series"], r["t"]): r["resid"] for r in arma_residuals(df, K, "t", "x", model, blocking=b).collect()}
             for b in (many, one)}
    assert resid[many].keys() == resid[one].keys()
    assert all(v is None and resid[one][k] is None or v == pytest.approx(resid[one][k], abs=1e-9)
               for k, v in resid[many].items())


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_any_size_of_group(make, group):
    df, model = make(SERIES), Arma(tuple(PHI), tuple(THETA))
    packed = arma.model_blocks(df, K, "t", "x", model, 3, Blocking(rows=20, grain=1))
    sums = {r["series"]: r for r in arma.chained(packed, K, "x", 3, True, group).collect()}
    states = {(r["series"], r["_block"]): r["_state"] for r in arma.block_starts(packed, K, "x", 3, group).collect()}
    for k, x in SERIES.items():
        e, _ = shocks(np.asarray(x), PHI, THETA, 3)
        assert sums[k]["cross"][0] == pytest.approx(float(e @ e))
        for b in range(1, 20):
            # times start at 1 and block b at time 20 b
            assert states[k, b][0] == pytest.approx(e[20 * b - 2], abs=1e-9)


# ---- several candidates refined -----------------------------------------------------------------

@pytest.mark.parametrize("rows", [50, 4096])
def test_refining_more_never_ends_worse(make, rows):
    draw = {f"s{k}": simulate(150, [0.3], [0.9], 20 + k) for k in range(4)}
    df, blocking = make(draw), Blocking(rows=rows, grain=1)
    board = {(r["series"], r["p"], r["q"], r["with_mean"]): r for r in order_leaderboard(
        df, K, "t", "x", 2, 2, 3, blocking=blocking).collect()}
    one, three, all_ = (
        {r["series"]: r for r in order_search(df, K, "t", "x", 2, 2, 3, blocking=blocking, refine_top=top).collect()}
        for top in (1, 3, 100))
    for k in draw:
        assert all_[k]["aicc"] <= three[k]["aicc"] + 1e-9 <= one[k]["aicc"] + 2e-9
        for found in (one, three, all_):
            r = found[k]
            start = board[k, r["p"], r["q"], r["with_mean"]]
            # conditioned alike, so a refined model is no worse than its own start
            assert r["drop"] == 5 and r["n_used"] == start["n_used"]
            assert r["aicc"] <= start["aicc"] + 1e-6
    with pytest.raises(ValueError, match="refine_top"):
        order_search(df, K, "t", "x", refine_top=0)
