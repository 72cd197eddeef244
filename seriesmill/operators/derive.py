"""Series derived from series: returns, tails, samples, fractional differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import dot, doubles, each, each_at, let
from ..session import stored
from .blocks import DEFAULT, Blocking, blocks, history, observations, own_names, unblock


@own_names
def cc_returns(
    df: DataFrame, keys: Sequence[str], t: str, price: str, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Continuously compounded returns ``ln p_t − ln p_{t−1}`` as ``(keys, t, ret)``.

    The first row of a series is dropped.  A price that is not positive gives
    NULL, as does the row after it.
    """
    rows = unblock(blocks(df, keys, t, [price], 1, blocking), keys, t, [price], {price: 1})
    now, prev = F.col(price), F.col(f"{price}_1")
    log = F.when((now > 0) & (prev > 0), F.ln(now) - F.ln(prev))
    return rows.where(F.col("pos") > 1).select(*keys, t, log.alias("ret"))


@own_names
def series_tail(
    df: DataFrame, keys: Sequence[str], t: str, x: str, k: int = 10,
) -> DataFrame:
    """The last ``k`` observations of each series with ``pos`` 1…k ascending.

    Each task keeps k + 1 rows per series before the shuffle (a group limit
    below the window), so a long series costs no more than a short one.  Two
    rows at one of these times stop the job.
    """
    latest = Window.partitionBy(*keys).orderBy(F.col(t).desc())
    kept = (
        observations(df, keys, t, [x])
        .withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= k + 1)
        .withColumn("_same", F.col(t) == F.lead(t).over(latest))
        .where(F.col("_back") <= k)
        .withColumn("_back", F.when(
            F.col("_same"), F.raise_error(F.lit("two observations of one series share a time")).cast("int"),
        ).otherwise(F.col("_back")))
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return kept.select(
        *keys, t, (size - F.col("_back") + 1).cast("int").alias("pos"), F.col(x).alias("x")
    )


def holdout(df: DataFrame, keys: Sequence[str], t: str, x: str, h: int = 3) -> DataFrame:
    """The last ``h`` observations as ``(keys, h, actual)`` with h = 1…h."""
    return series_tail(df, keys, t, x, h).select(
        *keys, F.col("pos").alias("h"), F.col("x").alias("actual")
    )


@own_names
def train_holdout_split(
    df: DataFrame, keys: Sequence[str], t: str, x: str, h: int = 3,
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """All observations with ``sample`` = train or holdout (the last ``h``).

    ``h`` numbers the hold-out rows 1…h and is NULL in the training sample.
    """
    rows = unblock(blocks(df, keys, t, [x], 0, blocking), keys, t, [x])
    step = (F.col("pos") - (F.col("n") - h)).cast("int")
    ahead = step >= 1
    return rows.select(
        *keys, t, F.col(x).alias("x"),
        F.when(ahead, "holdout").otherwise("train").alias("sample"),
        F.when(ahead, step - F.greatest(F.lit(h) - F.col("n"), F.lit(0)).cast("int")).alias("h"),
    )


def frac_weights(d: float, k: int) -> list[float]:
    """Weights of ``(1 − B)^d`` for lags 0…k."""
    weights = [1.0]
    for i in range(1, k + 1):
        weights.append(-weights[-1] * (d - i + 1) / i)
    return weights


#: Lags from which a weight is taken from the expansion of the gamma function, and blocks to a stretch.
FAR, STRETCH = 100_000, 4


def weights_between(d: float, first: int, last: int, lags: int) -> np.ndarray:
    """Weights of ``(1 − B)^d`` for the lags first…last; 0 outside 0…lags."""
    out = np.zeros(last - first + 1)
    lo, hi = max(first, 0), min(last, lags)
    if hi < lo:
        return out
    if lo < FAR:
        k = np.arange(1, hi + 1, dtype=float)
        out[lo - first:hi - first + 1] = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])[lo:]
    elif not (d >= 0 and float(d).is_integer()):  # else the weights have ended
        # Γ(k − d) / Γ(k + 1) by its expansion in 1 / k, which leaves out less than a rounding error here
        a, b = -d - 1, -d
        start = lo ** a * (1 + a * b / (2 * lo) + a * (a - 1) * (3 * b * b - (a + 1)) / (24 * lo * lo)) / math.gamma(-d)
        k = np.arange(lo + 1, hi + 1, dtype=float)
        out[lo - first:hi - first + 1] = start * np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
    return out


def _long_memory(df, keys, t, x, d, lags, blocking) -> DataFrame:
    """``frac_diff`` with a memory of many blocks.

    Neighbouring blocks form stretches of ``STRETCH``.  What a stretch adds to a
    later one, or to itself, is one convolution with the weights of the lags
    between them, by a Fourier transform over both lengths.  Pairs are found
    from a table of one small row per stretch, by its place in the series; a
    task holds one pair, and a later stretch gathers a sum per earlier one
    within reach.  Work grows with length times ``lags``.
    """
    keys = list(keys)
    packed = blocks(df, keys, t, [x], 0, blocking)
    spans = stored(
        packed.groupBy(*keys, F.floor(F.col("nth") / STRETCH).alias("_span")).agg(
            F.min("start").alias("_start"), F.flatten(F.transform(
                F.sort_array(F.collect_list(F.struct("nth", "obs"))), lambda b: b["obs"])).alias("_obs")))
    listed = spans.select(*keys, "_span", "_start", F.size("_obs").alias("_size"))
    # a stretch reaches those that begin in its own part of the series or the next
    width = lags + STRETCH * blocking.rows
    near = F.explode(F.array(F.floor(F.col("_start") / width), F.floor(F.col("_start") / width) + 1))
    later = listed.select(*keys, F.floor(F.col("_start") / width).alias("_part"), F.col("_span").alias("_to"),
                          F.col("_start").alias("_to_start"), F.col("_size").alias("_to_size"))
    ahead = F.col("_to_start") - F.col("_start")
    pairs = listed.withColumn("_part", near).join(later, [*keys, "_part"]).where(
        (ahead >= 0) & (ahead - F.col("_size") < lags)).select(
        *keys, "_span", "_to", ahead.cast("long").alias("_ahead"), "_to_size")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def added(values: pd.Series, ahead: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for v, offset, n in zip(values, ahead, size, strict=True):
            v = np.asarray(v, float)
            w = weights_between(d, offset - len(v) + 1, offset + n - 1, lags)
            room = 1 << (len(v) + len(w) - 1).bit_length()
            whole = np.fft.irfft(np.fft.rfft(v, room) * np.fft.rfft(w, room), room)
            out.append(whole[len(v) - 1:len(v) - 1 + n])
        return pd.Series(out)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def summed(parts: pd.Series) -> pd.Series:
        return pd.Series([np.sum([np.asarray(p, float) for p in many], axis=0) for many in parts])

    values = F.transform("_obs", lambda o: o[x])
    sums = (
        spans.join(pairs, [*keys, "_span"]).select(*keys, "_to", added(values, F.col("_ahead"), F.col("_to_size")).alias("_add"))
        .groupBy(*keys, F.col("_to").alias("_span")).agg(F.collect_list("_add").alias("_adds"))
        .withColumn("_sum", summed("_adds")).drop("_adds"))
    rows = F.zip_with("_obs", "_sum", lambda o, s: F.struct(o["t"].alias(t), s.alias("fd")))
    return spans.join(sums, [*keys, "_span"]).select(*keys, F.inline(rows))


@own_names
def frac_diff(
    df: DataFrame, keys: Sequence[str], t: str, x: str,
    d: float, lags: int, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Fractional difference ``(1 − B)^d x`` with the weights cut at ``lags``.

    The cut is part of the definition and has no default: for small d weights
    fall slowly, and what lies further back than ``lags`` observations is left
    out.  Result ``(keys, t, fd)``; history before the first observation counts as 0.

    Up to a block's length the values needed travel with the block.  A longer
    memory, up to the whole history, is summed over pairs of stretches of a few
    blocks (``_long_memory``).
    """
    if lags > blocking.rows:
        return _long_memory(df, keys, t, x, d, lags, blocking)
    packed = blocks(df, keys, t, [x], lags, blocking)
    weights = doubles(reversed(frac_weights(d, lags)))
    past = each(history(x, lags), lambda v: f"coalesce({v}, 0D)")
    rows = let(past, lambda h: let(weights, lambda w: each_at("obs", lambda o, i: (
        f"named_struct({t!r}, {o}.t, 'fd', {dot(f'slice({h}, {i} + 1, {lags + 1})', w)})"))))
    return packed.select(*keys, F.expr(f"inline({rows})"))
