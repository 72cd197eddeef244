"""Diagnostics of a series or of a model's residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, z_value
from .blocks import DEFAULT, Blocking, blocks, observations, own_names, require, unblock
from .moments import lag_products, lag_products_to
from .quantiles import ecdf, exact_quantiles

# the default lag limit grows with 10·log10(n): 130 serves 10^13 observations
DEFAULT_LAG_REACH = 130


@own_names
def sd_band(df: DataFrame, keys: Sequence[str], t: str, x: str, k: float = 3.0) -> DataFrame:
    """Mean, standard deviation and the band mean ± k·sd of each series."""
    stats = observations(df, keys, t, [x]).groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return stats.withColumns({
        "lower": F.col("mean") - k * F.col("sd"), "upper": F.col("mean") + k * F.col("sd")})


@own_names
def acf(
    df: DataFrame, keys: Sequence[str], t: str, x: str, max_lag: int | None = None,
    level: float = 0.95, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Autocorrelations ``(keys, lag, rho, limit)`` for lags 1…max_lag.

    By default up to ``floor(10·log10 n)``.  ``±limit`` is the white-noise band.
    A constant series has NULL ``rho``.
    """
    if max_lag is None:
        last = F.least(F.floor(10 * F.log10(F.col("n"))), F.col("n") - 1).cast("int")
        sums = lag_products_to(df, keys, t, x, last, DEFAULT_LAG_REACH, blocking)
    else:
        sums = lag_products(df, keys, t, x, max_lag, blocking).select(
            *keys, "n", "mean", F.col("c")[0].alias("c0"),
            F.posexplode("c").alias("lag", "c"),
        ).where((F.col("lag") > 0) & (F.col("lag") < F.col("n")))
    return sums.select(
        *keys, "lag",
        (F.col("c") / F.col("c0")).alias("rho"),
        (F.lit(z_value(level)) / F.sqrt("n")).alias("limit"),
    )


@own_names
def ljung_box(
    df: DataFrame, keys: Sequence[str], t: str, x: str, lag: int = 10, fit_df: int = 0,
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Ljung-Box test ``(keys, n, q, df, p_value)`` over the first ``lag`` lags.

    ``fit_df`` counts the fitted ARMA coefficients when x are residuals.  A
    series of at most ``lag`` observations or without variation gets NULLs.
    """
    if lag <= fit_df:
        raise ValueError("lag must exceed fit_df")
    terms = [f"c[{k}] * c[{k}] / nullif(greatest(n - {k}, 0), 0)" for k in range(1, lag + 1)]
    weighted = F.expr(f"n * (n + 2D) * ({' + '.join(terms)})")
    q = F.when(F.col("n") > lag, weighted / (F.col("c")[0] * F.col("c")[0]))
    return (
        lag_products(df, keys, t, x, lag, blocking)
        .select(*keys, "n", q.alias("q"), F.lit(lag - fit_df).alias("df"))
        .withColumn("p_value", chi2_tail(F.col("q"), lag - fit_df))
    )


@own_names
def fd_histogram(
    df: DataFrame, keys: Sequence[str], t: str, x: str, max_bins: int | None = 1_000_000,
) -> DataFrame:
    """Histogram ``(keys, bin, lo, hi, n)`` with the Freedman–Diaconis bin width.

    Equal bins over [min, max], closed on the right, the lowest value included;
    empty bins are listed.  Without spread between the quartiles the number of
    bins follows Sturges; a constant series has one bin.

    A few far values can ask for more bins than anyone wants to list: more than
    ``max_bins`` stop the job.  With ``max_bins=None`` there is no limit, and
    only bins that hold something are listed.  The order of observations does
    not matter here, so equal times are no error.
    """
    keys = list(keys)
    values = observations(df, keys, t, [x]).select(*keys, F.col(x).alias("v"))
    spread = F.col("max") - F.col("min")
    iqr = F.col("q")[1] - F.col("q")[0]
    width = 2 * iqr * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    count = (
        F.when(spread == 0, F.lit(1.0))
        .when(iqr == 0, F.ceil(F.log2("n") + 1).cast("double"))
        .otherwise(F.ceil(spread / F.nullif(width, F.lit(0.0))).cast("double"))
    )
    if max_bins is not None:
        too_many = F.raise_error(F.format_string(
            "a histogram needs %s bins, more than max_bins", count.cast("string")))
        count = F.when(count > max_bins, too_many.cast("double")).otherwise(count)
    plan = (
        exact_quantiles(values, keys, [0.25, 0.75])
        .withColumn("bins", count.cast("long"))
        .withColumn("step", spread / F.col("bins"))
        .select(*keys, "min", "max", "bins", "step")
    )
    place = F.greatest(F.lit(1), F.least(
        F.col("bins"),
        F.ceil((F.col("v") - F.col("min")) / F.nullif(F.col("step"), F.lit(0.0))).cast("long")))
    filled = (
        values.join(plan.select(*keys, "min", "bins", "step"), keys)
        .select(*keys, place.alias("bin"))
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    lo = (F.col("min") + (F.col("bin") - 1) * F.col("step")).alias("lo")
    hi = F.when(F.col("bin") == F.col("bins"), F.col("max")).otherwise(
        F.col("min") + F.col("bin") * F.col("step")).alias("hi")
    if max_bins is None:
        return filled.join(plan, keys).select(*keys, "bin", lo, hi, "n")
    edges = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin")).select(*keys, "bin", lo, hi)
    return edges.join(filled, [*keys, "bin"], "left").select(
        *keys, F.col("bin").cast("int").alias("bin"), "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy_measures(
    df: DataFrame, keys: Sequence[str], t: str, x: str = "x", resid: str = "resid",
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Training accuracy of a fit: me, rmse, mae, mpe, mape, mase and acf1.

    ``resid`` may be NULL where the model gives no fitted value.  The scale of
    ``mase`` is the mean absolute change from one observation to the next.  A
    percentage of an observation that is zero does not exist: ``mpe`` and
    ``mape`` are means over the others.
    """
    rows = unblock(
        blocks(df, keys, t, [x, resid], 1, blocking), keys, t, [x, resid], {x: 1, resid: 1})
    r, r1 = F.col(resid), F.col(f"{resid}_1")
    percent = 100 * F.try_divide(r, F.col(x))
    both = r1.isNotNull() & r.isNotNull()
    sums = rows.groupBy(*keys).agg(
        F.avg(r).alias("me"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"),
        F.avg(percent).alias("mpe"), F.avg(F.abs(percent)).alias("mape"),
        F.avg(F.abs(F.col(x) - F.col(f"{x}_1"))).alias("_scale"),
        F.sum(r * r1).alias("_cross"), F.sum(F.when(both, r + r1)).alias("_pair"),
        F.count(F.when(both, 1)).alias("_pairs"),
        F.sum(r * r).alias("_square"), F.count(r).alias("_n"),
    )
    m = F.col("me")
    return sums.select(
        *keys, "me", "rmse", "mae", "mpe", "mape",
        F.try_divide(F.col("mae"), F.col("_scale")).alias("mase"),
        F.try_divide(
            F.col("_cross") - m * F.col("_pair") + F.col("_pairs") * m * m,
            F.col("_square") - F.col("_n") * m * m,
        ).alias("acf1"),
    )


DISTRIBUTION_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@own_names
def diff_distribution(
    df: DataFrame, keys: Sequence[str], t: str, x: str = "diff",
) -> DataFrame:
    """Distribution of a difference per group, without assuming a family.

    n, mean, sd, population skewness and excess kurtosis, min, max and exact
    quantiles ``p05 … p95``.
    """
    keys = list(keys)
    require(df, [*keys, t, x])
    values = observations(df, keys, t, [x]).select(*keys, F.col(x).alias("v"))
    moments = [F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
               F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis")]
    quantiles = exact_quantiles(values, keys, DISTRIBUTION_PROBS, more=moments)
    return quantiles.select(
        *keys, "n", "mean", "sd", "skewness", "kurtosis", "min", "max",
        *[F.col("q")[i].alias(f"p{round(100 * p):02d}")
          for i, p in enumerate(DISTRIBUTION_PROBS)])


@own_names
def diff_ecdf(
    df: DataFrame, keys: Sequence[str], t: str, x: str = "diff",
) -> DataFrame:
    """Empirical distribution function of a difference at each of its values."""
    require(df, [*keys, t, x])
    return ecdf(observations(df, keys, t, [x]).select(*keys, F.col(x).alias("value")), keys)
