"""Lagged cross-products: the one pass that autocorrelations and fits share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import dot, each, let, total
from .blocks import DEFAULT, Blocking, blocks, history, lag_name, unblock


def lag_products(
    df: DataFrame, keys: Sequence[str], t: str, x: str, max_lag: int,
    blocking: Blocking = DEFAULT, edges: bool = False,
) -> DataFrame:
    """Per series: ``n``, ``mean`` and ``c`` with ``c[k] = Σ z_t z_{t−k}``, z = x − mean.

    ``c[0]`` is NULL for a constant series.  ``edges`` adds ``head`` and ``tail``, the first and last ``max_lag`` z.
    With them the cross-products over *any* row range t > M, and those of the
    uncentred series, follow without reading the data again (``gram``).
    """
    return block_products(blocks(df, keys, t, [x], max_lag, blocking), keys, t, x, max_lag, edges)


def block_products(
    packed: DataFrame, keys: Sequence[str], t: str, x: str, max_lag: int, edges: bool = False,
) -> DataFrame:
    """``lag_products`` of blocks whose halo holds at least ``max_lag`` values."""
    z = f"(`{x}` - mean)"
    lag = [z] + [f"(`{lag_name(x, k)}` - mean)" for k in range(1, max_lag + 1)]
    # n and mean are the same on every row of a series
    sums = ["max(n) AS n", "max(mean) AS mean"]
    # no sum of squares for a constant series: it would be rounding noise
    sums.append(f"if(max(`{x}`) > min(`{x}`), sum({z} * {z}), null) AS c0")
    sums += [f"coalesce(sum({z} * {lag[k]}), 0D) AS c{k}" for k in range(1, max_lag + 1)]
    arrays = {"c": [f"c{k}" for k in range(max_lag + 1)]}
    if edges:
        places = range(1, max_lag + 1)
        sums += [f"sum(if(pos = {j}, {z}, null)) AS h{j}" for j in places]
        sums += [f"sum(if(pos = n - {max_lag - j}, {z}, null)) AS t{j}" for j in places]
        arrays |= {"head": [f"h{j}" for j in places], "tail": [f"t{j}" for j in places]}
    return (
        unblock(packed, keys, t, [x], {x: max_lag})
        .groupBy(*keys).agg(*[F.expr(s) for s in sums])
        .select(*keys, "n", "mean", *[F.array(*names).alias(a) for a, names in arrays.items()])
    )


#: Products of a block up to which lags are taken one by one; beyond, by a Fourier transform.
DIRECT = 1 << 20


def correlations(values: np.ndarray, own: int, last: int, direct: int = DIRECT) -> np.ndarray:
    """``Σ z_i z_{i−k}`` over the last ``own`` values, for k = 0…last; what comes before them serves as lags.

    The block is padded with zeros, so that the cyclic products of a transform
    are the plain ones.  NaN stands for missing history and adds nothing.
    """
    z = np.nan_to_num(values)
    block, before = z[len(z) - own:], len(z) - own
    if before < last:
        z, before = np.concatenate([np.zeros(last - before), z]), last
    if (last + 1) * own <= direct:
        return np.correlate(z[before - last:], block, "valid")[::-1]
    size = 1 << (last + 2 * own - 1).bit_length()
    spectrum = np.fft.rfft(z[before - last:], size) * np.conj(np.fft.rfft(block, size))
    return np.fft.irfft(spectrum, size)[:last + 1][::-1]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def block_correlations(values: pd.Series, own: pd.Series, mean: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([correlations(np.asarray(v, float) - m, int(n), int(k))
                      for v, n, m, k in zip(values, own, mean, last, strict=True)])


def lag_products_to(
    df: DataFrame, keys: Sequence[str], t: str, x: str, last: Column, reach: int,
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """``(keys, n, mean, c0, lag, c)`` for lags 1…``last``, a per-series number.

    ``c0`` is NULL for a constant series.  ``last`` may use ``n`` and must not exceed ``reach``.
    """
    beyond = F.raise_error(F.lit(f"lags beyond {reach} are asked for")).cast("int")
    packed = blocks(df, keys, t, [x], reach, blocking).withColumn(
        "_last", F.when(last > reach, beyond).otherwise(last))
    products = block_correlations(F.expr(history(x, reach)), F.size("obs"), F.col("mean"), F.col("_last"))
    sums = (
        packed.select(
            *keys, "n", "mean", F.array_min(f"obs.{x}").alias("lo"),
            F.array_max(f"obs.{x}").alias("hi"), F.posexplode(products).alias("lag", "c"))
        .groupBy(*keys, "lag")
        .agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sum("c").alias("c"),
             (F.max("hi") > F.min("lo")).alias("varies"))
    )
    zero = sums.where("lag = 0").select(*keys, F.expr("if(varies, c, null)").alias("c0"))
    return sums.where("lag > 0").join(zero, list(keys)).select(
        *keys, "n", "mean", "c0", "lag", "c"
    )


def gram(order: str, depth: int, skip: str, raw: str) -> str:
    """SQL: cross-products ``G[i][j] = Σ_{t>skip} y_{t−i} y_{t−j}``, 0 <= i, j <= order.

    Reads the columns of ``lag_products(…, edges=True)`` with ``max_lag =
    depth``; ``order <= skip <= depth``.  y is z, or x where ``raw``.  Each
    entry is the full sum over its lag, less the few products that start too
    early or end too late for this pair of lags.
    """
    def entry(c: str, head: str, tail: str, i: str, j: str) -> str:
        def with_pair(near: str, far: str) -> str:
            def first(start: str, size: str) -> str:
                return f"slice({head}, {start}, {size})"

            def final(back: str, size: str) -> str:
                return f"slice({tail}, {depth + 1} - {back}, {size})"

            early = f"{skip} - {far}"
            centred = (
                f"get({c}, {far} - {near})"
                f" - {dot(first(f'{far} - {near} + 1', early), first('1', early))}"
                f" - {dot(final(near, near), final(far, near))}")
            # Σ z over all t is 0, so a range sum of z is minus the excluded ends
            ends = " - ".join(
                f"{total(first('1', f'{skip} - {lag}'))} - {total(final(lag, lag))}"
                for lag in (near, far))
            return f"if({raw}, {centred} + mean * (0D - {ends}) + (n - ({skip})) * mean * mean, {centred})"

        return let(f"least({i}, {j})", lambda near: let(
            f"greatest({i}, {j})", lambda far: with_pair(near, far)))

    lags = f"sequence(0, {order})"
    return let("c", lambda c: let("head", lambda h: let("tail", lambda t: each(
        lags, lambda i: each(lags, lambda j: entry(c, h, t, i, j))))))
