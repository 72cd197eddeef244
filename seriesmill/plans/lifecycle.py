"""The two workflows: prepare the price tables, then model each series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arma, diagnostics, forecast
from ..operators.align import (
    calendar_join, load_step_calendar, load_step_join, weekly_hourly_align, weekly_hourly_diff,
)
from ..operators.blocks import DEFAULT, Blocking, counted_blocking, observations
from ..operators.derive import holdout, train_holdout_split
from ..operators.prep import dst_adjust, harmonise_union


def prepare(
    hourly: DataFrame, weekly: DataFrame, load_steps: Sequence[DataFrame],
    renames: Sequence[Mapping[str, str]], holidays: DataFrame | None, dst_edges: DataFrame,
    keys: Sequence[str], t: str = "ts",
) -> DataFrame:
    """Hourly prices with load step, weekly price of their operating week and difference.

    Yearly load-step tables that have a time column ``ts`` after renaming are
    adjusted for clock changes, stacked to a calendar and matched by time;
    prices keep their times, and ``holidays`` is not needed.  Tables without one
    (``day_type, hour, load_step``) are renamed and stacked, looked up by day
    type and hour, and the clock changes applied to the prices.  Then the weekly
    price is paired.  Stays lazy.
    """
    stamped = ["ts" in (dict(names).get(c, c) for c in table.columns)
               for table, names in zip(load_steps, renames, strict=True)]
    if any(stamped):
        if not all(stamped):
            raise ValueError("some load-step tables have a time column ts and some have none")
        classified = calendar_join(hourly, t, load_step_calendar(load_steps, renames, dst_edges))
        return weekly_hourly_diff(weekly_hourly_align(classified, weekly, keys, t), t)
    if holidays is None:
        raise ValueError("load steps by day type need holidays")
    steps = harmonise_union(load_steps, renames)
    classified = load_step_join(hourly, t, holidays, steps)
    aligned = weekly_hourly_align(
        dst_adjust(classified, t, dst_edges), weekly, keys, t)
    return weekly_hourly_diff(aligned, t)


def analyse(
    df: DataFrame, keys: Sequence[str], t: str, x: str,
    order: tuple[int, int] | str = (3, 1), mean: bool = False, h: int = 3, level: float = 0.95,
    lag: int = 10, fit_df: int | None = None, blocking: Blocking = DEFAULT,
) -> dict[str, DataFrame]:
    """Fit, diagnose and forecast every series; the last ``h`` rows are held out.

    ``order="auto"`` takes the order from the search.  ``fit_df`` of the
    Ljung-Box test defaults to p + q and must be given with "auto", where it
    differs by series.  Only the fit runs at once; the tables are lazy and
    share the residuals, which are kept until ``result["fitted"].unpersist()``.
    """
    keys = list(keys)
    if blocking.grain is None:
        # counted once; all tables below have these times or some of them
        blocking = counted_blocking(observations(df, keys, t, [x]), keys, t, blocking.rows)
    split = train_holdout_split(df, keys, t, x, h, blocking)
    train = split.where("sample = 'train'").select(*keys, t, "x")
    if order == "auto":
        if fit_df is None:
            raise ValueError('order="auto" needs fit_df')
        model, max_p = arma.order_search(train, keys, t, "x", blocking=blocking), 5
    else:
        p, q = order
        fit_df = p + q if fit_df is None else fit_df
        model, max_p = arma.arma_fit_css(train, keys, t, "x", p, q, mean, blocking), p
    # read by four of the tables below
    fitted = arma.arma_residuals(train, keys, t, "x", model, max_p, blocking).persist(
        StorageLevel.MEMORY_AND_DISK)
    residuals = fitted.where(F.col("resid").isNotNull()).select(*keys, t, "resid")
    ahead = forecast.arma_forecast(train, keys, t, "x", model, h, level, max_p, blocking)
    actual = holdout(df, keys, t, x, h)
    return {
        "model": model,
        "coefficients": arma.coef_table(model, keys, level),
        "fitted": fitted,
        "accuracy": diagnostics.accuracy_measures(fitted, keys, t, blocking=blocking),
        "histogram": diagnostics.fd_histogram(residuals, keys, t, "resid"),
        "ljung_box": diagnostics.ljung_box(residuals, keys, t, "resid", lag, fit_df, blocking),
        "acf": diagnostics.acf(residuals, keys, t, "resid", blocking=blocking),
        "forecast": ahead,
        "errors": forecast.forecast_vs_actual(ahead, actual, keys),
        "band": diagnostics.sd_band(train, keys, t, "x"),
        "chart": forecast.forecast_chart_frame(train, ahead, actual, keys, t, "x"),
    }
