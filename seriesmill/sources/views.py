"""The operators from SQL: views over a table that is known to the session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..operators.blocks import DEFAULT, Blocking, counted_blocking, lagged
from ..operators.derive import cc_returns, frac_diff, series_tail
from ..operators.diagnostics import acf, fd_histogram, ljung_box, sd_band


def analysis_views(
    spark: SparkSession, table: str, keys: Sequence[str], t: str, x: str, lags: int = 3, test_lags: int = 10,
    fit_df: int = 0, tail: int = 10, d: float | None = None, cut: int | None = None, blocking: Blocking = DEFAULT,
) -> list[str]:
    """Register a temporary view per operator beside ``table`` (a table or view) and return their names.

    ``{table}_lagged``, ``_returns``, ``_tail``, ``_acf``, ``_ljung_box``,
    ``_band``, and with ``d`` and ``cut`` ``_frac_diff``: what the operator of
    that name gives, with its columns, so that SQL can select from it, join it
    and aggregate it.  Views are lazy; Catalyst plans a query and the operators
    behind it together.  Blocks are counted once, when this is called, for all
    of them; after rows with new times have come, call it again.
    ``_histogram`` is a function of its first pass, which also runs now.
    """
    df = spark.table(table)
    if blocking.grain is None:
        blocking = counted_blocking(df.where(df[t].isNotNull()), keys, t, blocking.rows)
    made = {
        "lagged": lagged(df, keys, t, x, lags, blocking),
        "returns": cc_returns(df, keys, t, x, blocking),
        "tail": series_tail(df, keys, t, x, tail),
        "acf": acf(df, keys, t, x, blocking=blocking),
        "ljung_box": ljung_box(df, keys, t, x, test_lags, fit_df, blocking),
        "band": sd_band(df, keys, t, x),
        "histogram": fd_histogram(df, keys, t, x),
    }
    if d is not None and cut is not None:
        made["frac_diff"] = frac_diff(df, keys, t, x, d, cut, blocking)
    prefix = table.replace(".", "_").replace("`", "")
    for name, frame in made.items():
        frame.createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in made]
