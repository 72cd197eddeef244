"""Forecasts, their errors and the frame behind a forecast chart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, doubles, each, fold, let
from ..functions.distributions import z_value
from .arma import Arma, arma_evaluate
from .blocks import DEFAULT, Blocking, require
from .derive import series_tail

HISTORY = 10


def arma_forecast(
    df: DataFrame, keys: Sequence[str], t: str, x: str, model: DataFrame | Arma,
    h: int = 3, level: float = 0.95, max_p: int = 5, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """``(keys, h, mean, se, lower, upper)`` for 1…h steps ahead.

    Future shocks are 0; ``se`` grows with the weights of past shocks.  The
    model is a table (say from ``arma_fit_css``) or given coefficients.
    """
    state = arma_evaluate(df, keys, t, x, model, max_p, blocking)
    return forecast_from(state, keys, h, level)


def forecast_from(
    state: DataFrame, keys: Sequence[str], h: int = 3, level: float = 0.95,
) -> DataFrame:
    """Forecasts from a table of ``arma_evaluate``; h + 1 small rows per series."""
    steps = f"sequence(1, {h})"
    past = each("slice(x_tail, 1, p)", lambda v: f"{v} - mu")

    def path(phi: str, theta: str, past: str) -> str:
        """Forecasts of steps 1…h: each joins the values, a zero joins the shocks."""
        def step(s: str, _: str) -> str:
            value = f"{dot(phi, f'slice({s}.x, 1, p)')} + {dot(theta, f'slice({s}.e, 1, q)')}"
            return f"named_struct('x', concat(array({value}), {s}.x), 'e', concat(array(0D), {s}.e))"

        start = f"named_struct('x', {past}, 'e', e_tail)"
        return let(fold(steps, start, step), lambda s: f"reverse(slice({s}.x, 1, {h}))")

    def weights(phi: str, theta: str) -> str:
        """How a shock carries over 0…h−1 steps."""
        def step(ws: str, j: str) -> str:
            terms = f"least(p, {j})"
            known = dot(f"slice({phi}, 1, {terms})", f"slice({ws}, 1, {terms})")
            return f"concat(array(coalesce(get({theta}, {j} - 1), 0D) + {known}), {ws})"

        return f"reverse({fold(f'slice({steps}, 1, {h - 1})', doubles([1.0]), step)})"

    def rows(mean: str, carry: str) -> str:
        return each(steps, lambda i: (
            f"named_struct('h', {i}, 'mean', get({mean}, {i} - 1) + mu, 'se',"
            f" sqrt(sigma2 * {dot(f'slice({carry}, 1, {i})', f'slice({carry}, 1, {i})')}))"))

    ahead = let("slice(coef, 1, p)", lambda phi: let(
        "slice(coef, p + 1, q)", lambda theta: let(past, lambda y: let(
            path(phi, theta, y), lambda mean: let(
                weights(phi, theta), lambda carry: rows(mean, carry))))))
    half = z_value(level) * F.col("se")
    # n > p: enough history for the first forecast
    return state.where("size(x_tail) >= p").select(*keys, F.expr(f"inline({ahead})")).withColumns(
        {"lower": F.col("mean") - half, "upper": F.col("mean") + half})


def forecast_vs_actual(
    forecast: DataFrame, actual: DataFrame, keys: Sequence[str],
) -> DataFrame:
    """``(keys, h, pred, actual, err, sq_err)``; ``err`` is actual − prediction.

    ``actual`` is ``(keys, h, actual)``, for instance from ``derive.holdout``.
    Steps without an actual value keep NULL errors.
    """
    require(forecast, [*keys, "h", "mean"])
    require(actual, [*keys, "h", "actual"])
    err = F.col("actual") - F.col("pred")
    return (
        forecast.select(*keys, "h", F.col("mean").alias("pred"))
        .join(actual.select(*keys, "h", "actual"), [*keys, "h"], "left")
        .select(*keys, "h", "pred", "actual", err.alias("err"), (err * err).alias("sq_err"))
    )


def forecast_chart_frame(
    train: DataFrame, forecast: DataFrame, actual: DataFrame, keys: Sequence[str],
    t: str, x: str, history: int = HISTORY,
) -> DataFrame:
    """Long chart data ``(keys, pos, label, value)``.

    Positions up to ``history`` are the last training values (a shorter sample
    starts later), the steps ahead follow.  Labels: history, predicted, lower, upper, actual.
    """
    ahead = (F.col("h") + history).cast("int").alias("pos")

    def line(frame: DataFrame, label: str, value: str) -> DataFrame:
        return frame.select(
            *keys, ahead, F.lit(label).alias("label"), F.col(value).alias("value"))

    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    past = series_tail(train, keys, t, x, history).select(
        *keys, (F.col("pos") + history - size).cast("int").alias("pos"), F.lit("history").alias("label"), F.col("x").alias("value"))
    # one scan of the forecast gives its three lines
    lines = forecast.select(*keys, ahead, F.col("mean").alias("predicted"), "lower", "upper").unpivot(
        [*keys, "pos"], ["predicted", "lower", "upper"], "label", "value")
    return reduce(DataFrame.unionByName, [past, lines, line(actual, "actual", "actual")])
