"""Stationary ARMA models for every series of a table.

``x_t = Σ φ_i x_{t−i} + e_t + Σ θ_j e_{t−j}``, centred on the sample mean where
a mean is asked for.  Coefficients minimise the conditional sum of squares; an
exact-likelihood fit differs at order 1/n, so results agree with such software
up to that order, not digit for digit.

A *model table* has one row per series with at least the keys, ``p``, ``q``,
``mu`` and ``coef`` (AR, then MA coefficients).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import (
    count_up, dot, doubles, each, let, mat_vec, solve_spd,
)
from ..functions.distributions import t_value
from ..session import cut
from . import recursion
from .blocks import BLOCK, DEFAULT, Blocking, attach, blocks, history, own_names
from .moments import block_products, gram

# orders of the long autoregression and the rows plain AR candidates condition on
LONG_AR = 10
SEARCH_SKIP = 5

#: Blocks whose recursions run side by side.
TOGETHER = 256

VECTOR = T.ArrayType(T.DoubleType())
MATRIX = T.ArrayType(VECTOR)
POINT = T.StructType().add("coef", VECTOR).add("cross", VECTOR).add("step", T.DoubleType())


@dataclass(frozen=True)
class Arma:
    """One model with given coefficients, the same for every series."""

    phi: Sequence[float] = ()
    theta: Sequence[float] = ()
    mu: float = 0.0

    @property
    def columns(self) -> dict[str, Column]:
        return {
            "p": F.lit(len(self.phi)), "q": F.lit(len(self.theta)),
            "with_mean": F.lit(self.mu != 0.0), "mu": F.lit(float(self.mu)),
            "coef": F.expr(doubles([*self.phi, *self.theta])),
        }


# ---- two-stage estimates from lagged cross-products -------------------------

def cross_products(depth: int) -> str:
    """SQL: ``struct<g, c>`` for the row's q, with_mean, long, reach and skip.

    ``g`` holds the cross-products of lags 0…reach over rows t > skip, from the
    columns of ``lag_products(…, depth, edges=True)``.  With MA terms a long
    autoregression stands in for the unknown shocks: ``c`` is the shock as a
    combination of lags 0, 1, …, one less that fit.
    """
    def shocks(g: str) -> str:
        square = each(f"slice({g}, 2, long)", lambda row: f"slice({row}, 2, long)")
        fitted = solve_spd(square, f"slice({g}[0], 2, long)")
        return f"concat(array(1D), {each(fitted, lambda v: f'-{v}')})"

    return let(gram("reach", depth, "skip", "not with_mean"), lambda g: (
        f"named_struct('g', {g}, 'c', if(q > 0, {shocks(g)}, {doubles([])}))"))


def regression() -> str:
    """SQL: ``struct<coef, sse>`` for the row's p and q, from ``cross_products``.

    Regressors are lags of x and, as the second stage, lags of the shock.  Both
    are combinations of lags of x, so the normal equations follow from ``g``.
    """
    lags = "sequence(0, reach)"
    own = each(count_up("p"), lambda i: each(lags, lambda at: f"if({at} = {i} + 1, 1D, 0D)"))
    past = each(count_up("q"), lambda j: each(
        lags, lambda at: f"if({at} > {j} and {at} <= long + {j} + 1,"
                         f" get(c, {at} - {j} - 1), 0D)"))

    def solve(rows: str, projected: str) -> str:
        normal = each(projected, lambda v: mat_vec(rows, v))
        return let(each(projected, lambda v: f"{v}[0]"), lambda rhs: let(
            solve_spd(normal, rhs), lambda coef: (
                f"named_struct('coef', {coef}, 'sse', g[0][0] - {dot(coef, rhs)})")))

    return let(f"concat({own}, {past})", lambda rows: let(
        each(rows, lambda r: mat_vec("g", r)), lambda projected: solve(rows, projected)))


def estimates(
    products: DataFrame, keys: Sequence[str], orders: Sequence[tuple[int, int]],
    means: Sequence[bool], depth: int,
) -> DataFrame:
    """Two-stage estimate of every order: keys, p, q, with_mean, mu, n, used, coef, sse.

    Cross-products and shocks are shared by the orders with the same q.
    ``inline`` computes each stage once per row; as a projection it would be
    copied into every expression that reads one of its fields.
    """
    groups: dict[tuple, list[int]] = {}
    top = max(p for p, _ in orders)
    for p, q in orders:
        long = max(LONG_AR, p + q + 5)
        group = (q, long, long + q, long + q) if q else (0, LONG_AR, top, max(top, SEARCH_SKIP))
        groups.setdefault(group, []).append(p)
    grid = F.array(*[
        F.struct(
            F.lit(q).alias("q"), F.lit(long).alias("long"), F.lit(reach).alias("reach"),
            F.lit(skip).alias("skip"), F.lit(m).alias("with_mean"),
            F.array(*[F.lit(p) for p in ps]).alias("ps"))
        for (q, long, reach, skip), ps in groups.items() for m in means])
    # few bytes but much arithmetic per row: dealt out by as many tasks as the session's shuffles have
    shared = products.select("*", F.inline(grid)).hint("rebalance")
    ready = shared.where("n > skip + 1").select(
        *keys, "n", "mean", "q", "long", "reach", "skip", "with_mean", "ps",
        F.expr(f"inline(array({cross_products(depth)}))"))
    single = ready.select("*", F.explode("ps").alias("p")).where("n > skip + p + q + 1")
    return single.select(
        *keys, "n", "mean", "p", "q", "with_mean", (F.col("n") - F.col("skip")).alias("used"),
        F.expr(f"inline(array({regression()}))"),
    ).select(*keys, "p", "q", "with_mean", centre().alias("mu"), "n", "used", "coef", "sse")


@own_names
def arma_fit_hr(
    df: DataFrame, keys: Sequence[str], t: str, x: str, p: int = 3, q: int = 1,
    mean: bool = False, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Two-stage regression estimate of ARMA(p, q), one pass over the data.

    A model table with ``n``, ``n_used``, ``sse`` and ``sigma2``.  A series too
    short has no row; a constant one has NULL coefficients.
    """
    depth = hr_depth(p, q)
    packed = series_blocks(df, keys, t, x, depth, blocking)
    return _estimated(block_products(packed, keys, t, x, depth, edges=True),
                      keys, p, q, mean, depth)


def hr_depth(p: int, q: int) -> int:
    """Lags the two-stage estimate of ARMA(p, q) looks back."""
    return max(LONG_AR, p + q + 5) + q if q else max(p, SEARCH_SKIP)


def _estimated(products, keys, p, q, mean, depth) -> DataFrame:
    found = estimates(products, keys, [(p, q)], [mean], depth)
    freedom = F.nullif(F.col("used") - p - q - int(mean), F.lit(0))
    return found.select(
        *keys, "p", "q", "with_mean", "mu", "coef", "n", F.col("used").alias("n_used"), "sse",
        (F.col("sse") / freedom).alias("sigma2"))


def centre() -> Column:
    return F.expr("if(with_mean, mean, 0D)")


# ---- blocks against models ----------------------------------------------------

def series_blocks(df, keys, t, x, depth: int, blocking: Blocking, per_series=None) -> DataFrame:
    return blocks(df, keys, t, [x], max(depth, 1), blocking, per_series)


def report_udf(slopes: bool):
    @F.pandas_udf(MATRIX)
    def report(values: pd.Series, own: pd.Series, skip: pd.Series, trials: pd.Series) -> pd.Series:
        tasks = [(np.asarray(v, float), len(v) - n, s, trial)
                 for v, n, s, many in zip(values, own, skip, trials) for trial in many]
        done = iter(recursion.score(tasks, slopes))
        return pd.Series([[next(done) for _ in many] for many in trials])

    return report


def block_inputs(x: str, depth: int) -> list[Column]:
    """A block's values behind ``depth`` earlier ones, its size, rows conditioned on."""
    own = F.size("obs")
    skip = F.greatest(F.col("drop") - F.col("start"), F.lit(0)).cast("int")
    return [F.expr(history(x, max(depth, 1))), own, skip]


#: Neighbouring blocks, or groups of blocks, whose reports become one.
GROUP = 1024


def merge_udf(slopes: bool):
    @F.pandas_udf(MATRIX)
    def merge(reports: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([
            [recursion.merged([b[i] for b in blocks_], int(p), int(q), slopes) for i, (p, q) in enumerate(many)]
            for blocks_, many in zip(reports, sizes)])

    return merge


def reports(
    packed: DataFrame, keys: Sequence[str], x: str, depth: int, slopes: bool,
    constant: Sequence[str] = (), group: int = GROUP,
) -> DataFrame:
    """Per group of ``group`` neighbouring blocks (``_group``): the blocks' reports in time order.

    Blocks carry ``drop`` (leading rows conditioned on) and ``trials``; a report
    has one part per trial, a few numbers each.  Columns in ``constant`` have
    one value per series and are kept.
    """
    sizes = F.transform("trials", lambda v: F.slice(v, 1, 2))
    scored = packed.select(
        *keys, BLOCK, "n", *constant, F.floor(F.col("nth") / group).cast("int").alias("_group"), sizes.alias("_sizes"),
        report_udf(slopes)(*block_inputs(x, depth), F.col("trials")).alias("report"),
        last_values(x, depth).alias("_recent"),
    )
    return scored.groupBy(*keys, "_group").agg(
        F.max("n").alias("n"),
        *[F.max(c).alias(c) for c in constant],
        F.max_by("_recent", BLOCK).alias("_recent"),
        F.any_value("_sizes").alias("_sizes"),
        F.sort_array(F.collect_list(F.struct(BLOCK, "report"))).alias("_reports"),
    ).select(*keys, "_group", "n", *constant, "_recent", "_sizes", F.col("_reports").getField(BLOCK).alias("at"),
             F.col("_reports").getField("report").alias("reports"))


def whole_reports(
    grouped: DataFrame, keys: Sequence[str], slopes: bool, constant: Sequence[str] = (),
) -> DataFrame:
    """Per series: ``n``, ``x_tail`` and the reports of its groups, each merged to one.

    A task merges the reports of one group; a series of B blocks then has B over
    1024 reports left to gather, where a single list would hold them all.
    """
    merged = grouped.withColumn("report", merge_udf(slopes)("reports", "_sizes"))
    return merged.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(c).alias(c) for c in constant],
        F.max_by("_recent", "_group").alias("x_tail"),
        F.sort_array(F.collect_list(F.struct("_group", "report"))).alias("_reports"),
    ).select(*keys, "n", *constant, "x_tail", F.col("_reports").getField("_group").alias("at"),
             F.col("_reports").getField("report").alias("reports"))


def last_values(x: str, depth: int) -> Column:
    """The block's last ``depth`` values including earlier ones, latest first."""
    return F.expr(f"slice(reverse(concat(halo.`{x}`, obs.`{x}`)), 1, {max(depth, 1)})")


def vector(c: dict[str, Column]) -> Column:
    """A model as ``[p, q, mu, coef…]``."""
    return F.concat(
        F.array(c["p"].cast("double"), c["q"].cast("double"), c["mu"].cast("double")), c["coef"])


def model_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in ("p", "q", "mu", "coef")}


# ---- evaluation at given coefficients -------------------------------------------

@F.pandas_udf(T.StructType().add("cross", VECTOR).add("starts", MATRIX).add("e_tail", VECTOR))
def chain_one(reports: pd.Series, p: pd.Series, q: pd.Series, slopes: pd.Series) -> pd.DataFrame:
    rows = []
    for blocks_, p_, q_, s in zip(reports, p, q, slopes):
        total, starts, tail = recursion.chain([b[0] for b in blocks_], int(p_), int(q_), bool(s))
        rows.append((total.ravel(), [list(v) for v in starts], tail))
    return pd.DataFrame(rows, columns=["cross", "starts", "e_tail"])


def model_blocks(
    df: DataFrame, keys: Sequence[str], t: str, x: str, model: DataFrame | Arma, max_p: int,
    blocking: Blocking,
) -> DataFrame:
    """Blocks with their series' model: p, q, mu, coef, with_mean, drop and trials."""
    if isinstance(model, Arma):
        depth = len(model.phi)
        packed = series_blocks(df, keys, t, x, depth, blocking).withColumns(
            {**model.columns, "drop": F.lit(depth)})
    else:
        deep = F.raise_error(F.lit(f"a model has more than max_p = {max_p} AR terms"))
        ready = model.where(F.col("coef").isNotNull()).withColumns({
            "p": F.when(F.col("p") > max_p, deep).otherwise(F.col("p")),
            "drop": F.col("drop") if "drop" in model.columns else F.col("p"),
            "with_mean": (F.col("with_mean") if "with_mean" in model.columns
                          else F.col("mu") != 0)})
        packed = series_blocks(
            df, keys, t, x, max_p, blocking, ready.select(*keys, *MODEL_COLUMNS))
    return packed.withColumn("trials", F.array(vector(model_columns())))


MODEL_COLUMNS = ["p", "q", "with_mean", "mu", "coef", "drop"]


def chained(
    packed: DataFrame, keys: Sequence[str], x: str, depth: int, slopes: bool, group: int = GROUP,
) -> DataFrame:
    """One row per series: the model, sums and the last values."""
    grouped = reports(packed, keys, x, depth, slopes, MODEL_COLUMNS, group)
    return whole_reports(grouped, keys, slopes, MODEL_COLUMNS).withColumn(
        "_sum", chain_one("reports", "p", "q", F.lit(slopes))
    ).select(*keys, *MODEL_COLUMNS, "n", "x_tail", "_sum.cross", "_sum.e_tail")


@F.pandas_udf(MATRIX)
def chain_starts(reports: pd.Series, p: pd.Series, q: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([
        [list(v) for v in recursion.chain([b[0] for b in blocks_], int(p_), int(q_), False, start)[1]]
        for blocks_, p_, q_, start in zip(reports, p, q, before)])


def block_starts(packed: DataFrame, keys: Sequence[str], x: str, depth: int, group: int = GROUP) -> DataFrame:
    """``(keys, _block, _state)``: the residual lags before each block.

    Up the tree, reports of blocks become one per group; down it, the lags before
    a group give those before each of its blocks.
    """
    grouped = reports(packed, keys, x, depth, False, ["p", "q"], group)
    begin = whole_reports(grouped, keys, False, ["p", "q"]).withColumn(
        "_sum", chain_one("reports", "p", "q", F.lit(False))
    ).select(*keys, F.explode(F.arrays_zip("at", "_sum.starts")).alias("_at")).select(
        *keys, F.col("_at.at").alias("_group"), F.col("_at.starts").alias("_before"))
    return grouped.join(begin, [*keys, "_group"]).withColumn(
        "starts", chain_starts("reports", "p", "q", "_before")
    ).select(*keys, F.explode(F.arrays_zip("at", "starts")).alias("_at")).select(
        *keys, F.col("_at.at").alias(BLOCK), F.col("_at.starts").alias("_state"))


def depth_of(model: DataFrame | Arma, max_p: int) -> int:
    return len(model.phi) if isinstance(model, Arma) else max_p


def criteria(n: Column, sse: Column, parameters: Column) -> dict[str, Column]:
    """Gaussian log-likelihood and information criteria; NULL where undefined."""
    k = parameters + 1
    per_row = F.when((n > 0) & (sse > 0), sse / F.nullif(n, F.lit(0)))
    loglik = -n / 2 * (F.ln(per_row * (2 * math.pi)) + 1)
    aic = -2 * loglik + 2 * k
    small = F.when(n > k + 1, 2 * k * (k + 1) / F.nullif(n - k - 1, F.lit(0)))
    return {"loglik": loglik, "aic": aic, "aicc": aic + small, "bic": -2 * loglik + k * F.ln(n)}


def summarise(fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model table from coefficients and the cross-products at them."""
    parameters = F.expr("p + q + int(with_mean)")
    size = "(p + q)"
    square = each(count_up(size), lambda i: f"slice(cross, ({i} + 1) * ({size} + 1) + 2, {size})")
    inverse = let(square, lambda a: each(count_up(size), lambda i: solve_spd(
        a, each(count_up(size), lambda j: f"if({i} = {j}, 1D, 0D)"))))
    table = fitted.withColumns({
        "n_used": F.col("n") - F.col("drop"), "sse": F.col("cross")[0],
    })
    freedom = F.col("n_used") - parameters
    table = table.withColumn(
        "sigma2", F.when(freedom > 0, F.col("sse") / F.nullif(freedom, F.lit(0)))
    ).withColumn("vcov", F.expr(each(inverse, lambda row: each(row, lambda v: f"{v} * sigma2"))))
    measures = criteria(F.col("n_used"), F.col("sse"), parameters)
    extra = [c for c in ("x_tail", "e_tail", "step", "converged") if c in fitted.columns]
    return table.select(
        *keys, "p", "q", "with_mean", "mu", "drop", "coef", "n", "n_used", "sse", "sigma2",
        "vcov", *[c.alias(name) for name, c in measures.items()], *extra)


@own_names
def arma_evaluate(
    df: DataFrame, keys: Sequence[str], t: str, x: str, model: DataFrame | Arma,
    max_p: int = 5, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Sum of squares, variances and criteria at given coefficients, no fitting.

    ``x_tail`` and ``e_tail`` hold the last values and residuals, latest first.
    ``max_p`` bounds the AR orders in a model table.
    """
    depth = depth_of(model, max_p)
    packed = model_blocks(df, keys, t, x, model, max_p, blocking)
    return summarise(chained(packed, keys, x, depth, True), keys)


@F.pandas_udf(VECTOR)
def residual_values(
    values: pd.Series, own: pd.Series, skip: pd.Series, model: pd.Series, start: pd.Series,
) -> pd.Series:
    out = []
    for at in range(0, len(values), TOGETHER):
        part = slice(at, at + TOGETHER)
        rows = list(zip(values[part], own[part], skip[part], model[part], start[part], strict=True))
        most_q = max(int(m[1]) for *_, m, _ in rows)
        shocks = np.zeros((max((int(n) for _, n, *_ in rows), default=0), len(rows)))
        theta, before = np.zeros((most_q, len(rows))), np.zeros((most_q, len(rows)))
        for column, (v, n, s, m, begin) in enumerate(rows):
            p, q, n = int(m[0]), int(m[1]), int(n)
            y = np.nan_to_num(np.asarray(v, float)[len(v) - n - p:] - m[2])
            u = y[p:].copy()
            for i in range(p):
                u -= m[3 + i] * y[p - 1 - i:p - 1 - i + n]
            u[:min(int(s), n)] = 0.0
            shocks[:n, column] = u
            theta[:q, column] = m[3 + p:3 + p + q]
            before[most_q - q:, column] = np.asarray(begin, float)[::-1]
        # one step of all blocks at a time; shorter blocks run on over zeros, unread
        found = recursion.recurse(shocks, theta, before)[most_q:]
        for column, (_, n, s, *_) in enumerate(rows):
            s = min(int(s), int(n))
            out.append([None] * s + found[s:int(n), column].tolist())
    return pd.Series(out)


@own_names
def arma_residuals(
    df: DataFrame, keys: Sequence[str], t: str, x: str, model: DataFrame | Arma,
    max_p: int = 5, blocking: Blocking = DEFAULT,
) -> DataFrame:
    """``(keys, t, x, fitted, resid)``; NULL for the first p rows, conditioned on.

    First the state at each block start follows from the blocks' reports, merged
    in groups, then all blocks are filtered in parallel.
    """
    keys = list(keys)
    depth = depth_of(model, max_p)
    packed = model_blocks(df, keys, t, x, model, max_p, blocking)
    begin = block_starts(packed, keys, x, depth)
    values = residual_values(
        *block_inputs(x, depth), vector(model_columns()), F.col("_state"))
    rows = packed.hint("merge").join(begin, [*keys, BLOCK]).withColumn("_e", values)
    pairs = F.zip_with("obs", "_e", lambda o, e: F.struct(
        o["t"].alias(t), o[x].alias("x"), (o[x] - e).alias("fitted"), e.alias("resid")))
    return rows.select(*keys, F.inline(pairs))


# ---- conditional least squares ---------------------------------------------------

@F.pandas_udf(VECTOR)
def steady_coef(coef: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else recursion.steady(c, int(a), int(b))
                      for c, a, b in zip(coef, p, q)])


@F.pandas_udf(POINT)
def refine_whole(
    values: pd.Series, own: pd.Series, skip: pd.Series, model: pd.Series,
) -> pd.DataFrame:
    tasks = [(np.asarray(v, float), len(v) - n, s, m)
             for v, n, s, m in zip(values, own, skip, model)]
    rows = [(coef, None if total is None else total.ravel(), step)
            for coef, total, step in recursion.refine(tasks)]
    return pd.DataFrame(rows, columns=["coef", "cross", "step"])


@F.pandas_udf(T.StructType([*POINT, T.StructField("trials", MATRIX)]))
def next_round(
    reports: pd.Series, trials: pd.Series, coef: pd.Series, cross: pd.Series,
    p: pd.Series, q: pd.Series, mu: pd.Series,
) -> pd.DataFrame:
    rows = []
    for blocks_, tried, at, sums, p_, q_, mu_ in zip(reports, trials, coef, cross, p, q, mu):
        p_, q_ = int(p_), int(q_)
        size = 1 + p_ + q_
        totals = [recursion.chain([b[i] for b in blocks_], p_, q_)[0] for i in range(len(tried))]
        held = None if sums is None else np.asarray(sums).reshape(size, size)
        at, total, step, more = recursion.search_step(
            [np.asarray(v[3:]) for v in tried], totals, np.asarray(at), held, p_, q_)
        rows.append((at, None if total is None else total.ravel(), step,
                     [recursion.model_vector(p_, q_, mu_, c) for c in more]))
    return pd.DataFrame(rows, columns=["coef", "cross", "step", "trials"])


STEP_LIMIT = 1e-6


def refine_models(
    packed: DataFrame, keys: Sequence[str], x: str, depth: int, start: DataFrame,
    rounds: int = recursion.ROUNDS,
) -> DataFrame:
    """Gauss–Newton with step halving from the coefficients in ``start``.

    ``start`` may hold several models of a series that differ in p, q or
    ``with_mean``; all are refined side by side.  A series within one block is
    refined where it lies.  A longer one takes one round of distributed reports
    per step; only one row of state per model, written to the checkpoint folder,
    passes from round to round.
    """
    keys = list(keys)
    names = ["p", "q", "with_mean", "mu", "drop"]
    model = [*keys, "p", "q", "with_mean"]
    state = cut(start.where(F.col("coef").isNotNull()).select(*keys, *names, "coef")).withColumn(
        "coef", steady_coef("coef", "p", "q"))
    whole = F.size("obs") == F.col("n")
    result = (
        attach(packed.where(whole), keys, state.select(*keys, *names, "coef"))
        .withColumn("_fit", refine_whole(*block_inputs(x, depth), vector(model_columns())))
        .select(*keys, *names, "n", "_fit.coef", "_fit.cross", "_fit.step")
    )
    long = packed.where(~whole)
    if not long.isEmpty():
        lengths = long.groupBy(*keys).agg(F.max("n").alias("n"))
        state = cut(state.join(lengths, keys).select(
            *keys, *names, "n", "coef", F.lit(None).cast("array<double>").alias("cross"),
            F.lit(None).cast("double").alias("step"),
            F.array(vector(model_columns())).alias("trials")))
        for _ in range(rounds):
            live = state.where(F.size("trials") > 0)
            if live.isEmpty():
                break
            grouped = reports(
                attach(long, keys, live.select(*model, "drop", "trials")), model, x, depth, True)
            moved = (
                whole_reports(grouped, model, True).select(*model, "reports")
                .join(live, model)
                .withColumn("_next", next_round("reports", "trials", "coef", "cross",
                                                "p", "q", "mu"))
                .select(*keys, *names, "n", "_next.*")
            )
            state = cut(state.where(F.size("trials") == 0).unionByName(moved))
        result = result.unionByName(state.drop("trials"))
    result = result.withColumns({
        "converged": F.col("step") <= STEP_LIMIT,
        "step": F.when(F.col("step") < float("inf"), F.col("step")),
    })
    return summarise(result, keys)


@own_names
def arma_fit_css(
    df: DataFrame, keys: Sequence[str], t: str, x: str, p: int = 3, q: int = 1,
    mean: bool = False, blocking: Blocking = DEFAULT, rounds: int = recursion.ROUNDS,
) -> DataFrame:
    """ARMA(p, q) by conditional least squares, started from the two-stage estimate.

    Runs when called.  Model table with variances, criteria, ``step`` (size of
    the step still proposed) and ``converged``; where no step lowers the sum of
    squares the start is returned.  ``mean=False`` does not centre the series.
    """
    depth = hr_depth(p, q)

    def start(packed: DataFrame) -> DataFrame:
        products = cut(block_products(packed, keys, t, x, depth, edges=True))
        return _estimated(products, keys, p, q, mean, depth).withColumn("drop", F.lit(p))

    return _over_blocks(
        df, keys, t, x, depth, blocking, lambda packed: refine_models(packed, keys, x, p, start(packed), rounds))


def _over_blocks(df, keys, t, x, depth, blocking, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A small result of several passes over the blocks, which are built once and kept meanwhile."""
    packed = series_blocks(df, keys, t, x, depth, blocking).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cut(result(packed))
    finally:
        packed.unpersist()


# ---- order search --------------------------------------------------------------------

@F.pandas_udf(VECTOR)
def chain_sums(reports: pd.Series, trials: pd.Series) -> pd.Series:
    return pd.Series([
        [float(recursion.chain([b[i] for b in blocks_], int(m[0]), int(m[1]), False)[0][0, 0])
         for i, m in enumerate(many)]
        for blocks_, many in zip(reports, trials)])


def candidate_orders(max_p: int, max_q: int, max_order: int | None) -> Iterator[tuple[int, int]]:
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            if max_order is None or p + q <= max_order:
                yield p, q


@own_names
def order_leaderboard(
    df: DataFrame, keys: Sequence[str], t: str, x: str, max_p: int = 5, max_q: int = 5,
    max_order: int | None = 5, means: Sequence[bool] = (False, True),
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Every candidate order of each series with its criteria, ranked by AICc.

    All candidates come from one set of lagged cross-products.  Plain AR sums of
    squares follow from it too; models with MA terms are scored in one more
    pass over the same blocks that runs every candidate over each; with MA terms
    the whole runs when called.  All condition on the same first 5 rows, or as
    many as the largest p, so the criteria are comparable.
    """
    depth = search_depth(max_p, max_q, max_order)

    def board(packed: DataFrame) -> DataFrame:
        products = block_products(packed, keys, t, x, depth, edges=True)
        return _leaderboard(packed, products, keys, x, max_p, max_q, max_order, means)

    if not max_q:
        return board(series_blocks(df, keys, t, x, depth, blocking))
    return _over_blocks(df, keys, t, x, depth, blocking, board)


def search_skip(max_p: int, max_q: int, max_order: int | None) -> int:
    """Leading rows that every candidate is conditioned on."""
    return max(SEARCH_SKIP, max(p for p, _ in candidate_orders(max_p, max_q, max_order)))


def search_depth(max_p: int, max_q: int, max_order: int | None) -> int:
    return max(search_skip(max_p, max_q, max_order), *(
        hr_depth(p, q) for p, q in candidate_orders(max_p, max_q, max_order)))


def _leaderboard(packed, products, keys, x, max_p, max_q, max_order, means) -> DataFrame:
    keys = list(keys)
    depth, skip = search_depth(max_p, max_q, max_order), search_skip(max_p, max_q, max_order)
    orders = list(candidate_orders(max_p, max_q, max_order))
    found = estimates(products, keys, orders, means, depth).drop("used").where(
        F.col("coef").isNotNull())
    if max_q:
        # one small row per series and order, read by three branches
        found = cut(found)
        mixed = found.where("q > 0").withColumn("coef", steady_coef("coef", "p", "q"))
        trial = F.struct("p", "q", "with_mean", "mu", "coef",
                         vector(model_columns()).alias("trial"))
        per_series = mixed.groupBy(*keys).agg(F.sort_array(F.collect_list(trial)).alias("_all"))
        tried = per_series.select(
            *keys, "_all", F.col("_all.trial").alias("trials"), F.lit(skip).alias("drop"))
        grouped = reports(attach(packed, keys, tried.select(*keys, "drop", "trials")), keys, x, max_p, False)
        sums = (
            whole_reports(grouped, keys, False).join(tried, keys)
            .withColumn("_sse", chain_sums("reports", "trials"))
            .select(*keys, "n", F.inline(F.arrays_zip("_all", "_sse")))
            .select(*keys, "n", "_all.p", "_all.q", "_all.with_mean", "_all.mu", "_all.coef",
                    F.when(~F.isnan("_sse"), F.col("_sse")).alias("sse"))
        )
        found = found.where("q = 0").unionByName(sums)
    parameters = F.expr("p + q + int(with_mean)")
    used = F.col("n") - skip
    scored = found.withColumns({
        "n_used": used, **criteria(used, F.col("sse"), parameters)})
    rank = Window.partitionBy(*keys).orderBy(F.col("aicc").asc_nulls_last(), "p", "q", "with_mean")
    return scored.withColumn("rank", F.row_number().over(rank))


@own_names
def order_search(
    df: DataFrame, keys: Sequence[str], t: str, x: str, max_p: int = 5, max_q: int = 5,
    max_order: int | None = 5, means: Sequence[bool] = (False, True), refine: bool = True,
    blocking: Blocking = DEFAULT, refine_top: int = 1,
) -> DataFrame:
    """The order with the least AICc per series, refined by least squares.

    The whole grid is scored at two-stage estimates.  The ``refine_top`` best
    candidates of each series are refined side by side (a run when called), and
    the least AICc after that wins; with more of them it never gets worse.
    Refined models are conditioned on the same leading rows (``drop``) as the
    leaderboard, so their criteria compare with each other and with it.
    ``refine=False`` returns the leaderboard's first row.
    """
    keys = list(keys)
    if refine_top < 1:
        raise ValueError("refine_top must be 1 or more; refine=False refines nothing")
    if not refine:
        board = order_leaderboard(df, keys, t, x, max_p, max_q, max_order, means, blocking)
        return board.where("rank = 1").drop("rank")

    depth, skip = search_depth(max_p, max_q, max_order), search_skip(max_p, max_q, max_order)

    def best(packed: DataFrame) -> DataFrame:
        products = block_products(packed, keys, t, x, depth, edges=True)
        board = _leaderboard(packed, products, keys, x, max_p, max_q, max_order, means)
        start = board.where(F.col("rank") <= refine_top).withColumn("drop", F.lit(skip))
        refined = refine_models(packed, keys, x, max_p, start)
        order = Window.partitionBy(*keys).orderBy(F.col("aicc").asc_nulls_last(), "p", "q", "with_mean")
        return refined.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")

    return _over_blocks(df, keys, t, x, depth, blocking, best)


# ---- coefficient table ------------------------------------------------------------------

def coef_table(models: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """``(keys, term, estimate, std_err, t_value, critical, significant)``.

    Needs a model table with ``vcov`` and ``n``.  The critical value is the
    Student quantile with n less the number of coefficients as degrees of freedom.
    """
    at, p = F.col("_at"), F.col("p")
    term = F.when(at < p, F.concat(F.lit("AR"), at + 1)).otherwise(
        F.concat(F.lit("MA"), at - p + 1))
    freedom = F.col("n") - (p + F.col("q") + F.col("with_mean").cast("int"))
    variance = F.get(F.get("vcov", at), at)
    return (
        models.select("*", F.posexplode("coef").alias("_at", "estimate"))
        .select(*keys, term.alias("term"), "estimate",
                F.sqrt(F.when(variance > 0, variance)).alias("std_err"),
                t_value(level, freedom.cast("double")).alias("critical"))
        .withColumn("t_value", F.col("estimate") / F.col("std_err"))
        .withColumn("significant", F.abs("t_value") > F.col("critical"))
        .select(*keys, "term", "estimate", "std_err", "t_value", "critical", "significant")
    )
