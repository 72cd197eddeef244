"""Ordered work on series of any length.

A window partitioned by series would put a whole series into one task.  Here a
series is cut along its time axis into blocks of at most ``Blocking.rows``
observations, and rows are shuffled by ``(series, block)``, so the longest
series spreads over as many tasks as a thousand short ones.  What an
observation needs from earlier blocks (its lags, its position, the length and
mean of the series) comes from a summary holding one row per block; only that
summary is ever grouped by series.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import each_at, let, total
from ..session import per_group, stored

BLOCK = "_block"


@dataclass(frozen=True)
class Blocking:
    """How finely a series is cut: into blocks of at most ``rows`` observations.

    By default blocks are counted (``counted_blocking``), whatever the spacing
    of the observations.  With ``grain``, the closest spacing of two
    observations, blocks are equal stretches of time and nothing is counted:
    seconds for timestamps, days for dates, units for whole numbers.  As
    ``(series, t)`` is unique, a block then holds at most ``rows`` observations.
    Rows closer together than ``grain`` make blocks larger, rows further apart
    make more of them than needed.
    """

    rows: int = 4096
    grain: float | None = None

    def block_id(self, df: DataFrame, t: str) -> Column:
        at, grain, per_grain = units(df, t)
        width = max(1, round(self.rows * (self.grain or grain) * per_grain))
        return F.floor((at - F.pmod(at, F.lit(width))) / F.lit(width)).cast("long")

    def placed(self, df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
        """``df`` with the block of each row."""
        if self.grain is None:
            return counted_blocking(df, keys, t, self.rows).placed(df, keys, t)
        return df.withColumn(BLOCK, self.block_id(df, t))


def units(df: DataFrame, t: str) -> tuple[Column, int, int]:
    """Time as whole numbers, the usual spacing of observations, and how many units a unit of ``grain`` has."""
    kind, at = df.schema[t].dataType, F.col(t)
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long"), 1, 1
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at), 3600, 1_000_000
    if isinstance(kind, T.TimestampNTZType):
        # calendar arithmetic: independent of the session time zone
        minutes = (F.unix_date(F.to_date(at)).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECONDS"), at) * 1_000_000).cast("long"), 3600, 1_000_000
    if isinstance(kind, T.IntegralType):
        return at.cast("long"), 1, 1
    raise TypeError(f"{t} must be a date, timestamp or whole number, not {kind}")


DEFAULT = Blocking()

#: Parts into which a stretch of time with too many rows is cut at least.
PARTS = 32


@dataclass(frozen=True)
class Counted(Blocking):
    """Blocks with bounds of their own in every series.

    ``series`` holds the first time of each series and the width of its
    stretches, ``splits`` the stretches that were cut again and the width of
    their parts, one table per round, and ``stretches`` the block of each
    stretch.  A time outside the stretches that were counted stops the job.
    """

    series: DataFrame | None = None
    splits: tuple[DataFrame, ...] = ()
    stretches: DataFrame | None = None

    def placed(self, df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
        rows = _stretched(df.withColumn("_unit", units(df, t)[0]), keys, self.series)
        for split in self.splits:
            rows = rows.join(split, [*keys, "_begin"], "left").withColumn("_begin", F.when(
                F.col("_part").isNotNull(), _begin("_part")).otherwise(F.col("_begin"))).drop("_part")
        rows = rows.join(self.stretches, [*keys, "_begin"], "left")
        missed = F.raise_error(F.lit("a time lies where none was when blocks were counted")).cast("long")
        return rows.select(*df.columns, F.when(F.col("_place").isNull(), missed).otherwise(F.col("_place")).alias(BLOCK))


    def renamed(self, names: Mapping[str, str]) -> Counted:
        """The same bounds for keys of other names."""
        names = dict(names)
        return replace(
            self, series=self.series.withColumnsRenamed(names), stretches=self.stretches.withColumnsRenamed(names),
            splits=tuple(s.withColumnsRenamed(names) for s in self.splits))


def _begin(width: str) -> Column:
    """Start of the part of the given width that holds ``_unit``, counted from ``_begin``."""
    return F.col("_unit") - F.pmod(F.col("_unit") - F.col("_begin"), F.col(width))


def _stretched(rows: DataFrame, keys: Sequence[str], series: DataFrame) -> DataFrame:
    return rows.join(series, list(keys), "left").withColumn("_begin", _begin("_width"))


def counted_blocking(
    df: DataFrame, keys: Sequence[str], t: str, rows: int = DEFAULT.rows,
) -> Blocking:
    """Blocks of at most ``rows`` observations and at most ``2 n / rows + 2`` per series, for any mix of spacings.

    Runs when called and reads keys and time only.  One job tries blocks of equal
    time at the usual spacing (an hour for timestamps, a day for dates, 1 for
    whole numbers); where they hold for every series they are kept.  Otherwise
    each series gets bounds of its own: its span is cut into stretches of equal
    time, about ``4 n / rows`` of them, rows are counted per stretch, and
    stretches with more than ``rows / 2`` are cut again in proportion to their
    rows, round by round, until none is left.  Prefix sums of the counts then
    join neighbouring stretches to blocks.  Rounds count only the rows of full
    stretches; even data take one.

    What meets in one task is a series' list of stretches, a small part of its
    rows.  The tables of bounds are written to the shared folder; they go to
    every task if they are small and into ordinary joins if not.  The result
    serves every table with the same keys and times, or some of them.
    """
    keys = list(keys)
    at, grain, _ = units(df, t)
    known = df.where(F.col(t).isNotNull())
    equal = Blocking(rows, grain)
    per_series = (
        known.select(*keys, equal.block_id(df, t).alias("_place"), at.alias("_unit"))
        .groupBy(*keys, "_place").agg(F.count(F.lit(1)).alias("_n"), F.min("_unit").alias("_lo"), F.max("_unit").alias("_hi"))
        .groupBy(*keys).agg(
            F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_blocks"), F.sum("_n").alias("_n"),
            F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    uneven = (F.col("_most") > rows) | (F.col("_blocks") > 2 * F.col("_n") / rows + 2)
    if per_series.where(uneven).isEmpty():
        return equal
    half = max(1, rows // 2)

    def wide(span: Column, parts: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(span / parts)).cast("long")

    wanted = F.ceil(4 * F.col("_n") / rows)
    series = per_group(per_series.select(
        *keys, F.col("_lo").alias("_begin"), wide(F.col("_hi") - F.col("_lo") + 1, wanted).alias("_width")))
    active = _stretched(known.select(*keys, at.alias("_unit")), keys, series)
    splits, done = [], []
    while True:
        counts = stored(active.groupBy(*keys, "_begin", "_width").agg(F.count(F.lit(1)).alias("_n")))
        # rows that share one unit of time cannot be parted; packing reports them
        full = (F.col("_n") > half) & (F.col("_width") > 1)
        done.append(counts.where(~full).select(*keys, "_begin", "_n"))
        if counts.where(full).isEmpty():
            break
        splits.append(per_group(counts.where(full).select(
            *keys, "_begin", wide(F.col("_width"), F.greatest(F.lit(PARTS), wanted)).alias("_part"))))
        active = active.drop("_width").join(splits[-1], [*keys, "_begin"]).withColumns(
            {"_begin": _begin("_part"), "_width": F.col("_part")}).drop("_part")
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1))
    stretches = reduce(DataFrame.unionByName, done).select(
        *keys, "_begin", F.floor(F.coalesce(before, F.lit(0)) / half).cast("long").alias("_place"))
    return Counted(rows, grain, series, tuple(splits), per_group(stretches))


def fitted_blocking(
    df: DataFrame, keys: Sequence[str], t: str, rows: int = DEFAULT.rows,
) -> Blocking:
    """Blocking measured on ``df``, whatever its spacing: no block holds more than ``rows`` observations,
    and the fullest at least half as many, if there are that many.

    Runs a few counting jobs that read only keys and time.  The fullest block is
    counted, and the width changed in proportion: narrower for dense data, wider
    for sparse.  If more than ``rows`` observations of a series share one unit of
    time (a day, a microsecond, a whole number), no blocking can be fitted and
    ValueError is raised.
    """
    daily = isinstance(df.schema[t].dataType, (T.DateType, T.IntegralType))
    least = 1 / rows if daily else 1e-6 / rows
    grain = 1.0 if daily else 3600.0
    known = df.where(F.col(t).isNotNull())
    fits = None
    for _ in range(24):
        blocking = Blocking(rows, grain)
        counts = known.groupBy(*keys, blocking.block_id(df, t).alias(BLOCK)).count()
        fullest, most = counts.agg(F.max("count"), F.count(F.lit(1)) - F.count_distinct(*keys)).first()
        fullest = fullest or 0
        if fullest <= rows:
            fits = blocking
            if 2 * fullest >= rows or not most:
                return fits
            # not quite to the brim, as the fullest of the wider blocks may be fuller
            grain *= max(2.0, 0.8 * rows / max(fullest, 1))
        elif fits is not None:
            return fits
        elif grain <= least:
            raise ValueError(f"{fullest} observations of a series share one unit of time; blocks hold {rows}")
        else:
            grain = max(least, grain * rows / fullest * 0.8)
    if fits is None:
        raise ValueError("the spacing of times is too uneven to fit blocks")
    return fits


#: Columns that operators use inside, and so the names that a table's own columns must not meet there.
INSIDE = frozenset((
    "n", "mean", "obs", "halo", "start", "nth", "pos", "t", "lag", "c", "c0", "head", "tail", "v", "p", "q", "mu", "coef",
    "with_mean", "drop", "trials", "step", "cross", "starts", "e_tail", "x_tail", "report", "reports", "at", "used", "sse",
    "g", "long", "reach", "skip", "ps", "rank", "min", "max", "bins", "bin", "lo", "hi", "price", "x", "resid", "fitted"))


def own_names(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator ``op(df, keys, t, x, …)`` work on columns of any name.

    Where one of the four has a name that is used inside, the operator sees the
    table, and model tables with the same keys, under other names, and the keys
    and the time get their names back in the result.  A result that has a column
    of its own by such a name cannot be told apart: ValueError.
    """
    signature = inspect.signature(op)
    df_, keys_, t_, x_ = list(signature.parameters)[:4]

    @wraps(op)
    def run(*args, **more) -> DataFrame:
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        given = bound.arguments
        df, keys, t, x = given[df_], list(given[keys_]), given[t_], given[x_]
        # a time column's name comes back in the result, so "t" itself is fine
        if not INSIDE.intersection([*keys, *({t} - {"t"}), *({x} - {"x", "price", "resid"})]):
            return op(*args, **more)
        require(df, [*keys, t, x])
        inner = {k: f"_key{i}" for i, k in enumerate(keys)}
        for name, value in list(given.items())[4:]:
            if isinstance(value, DataFrame):
                given[name] = value.withColumnsRenamed({k: c for k, c in inner.items() if k in value.columns})
            elif isinstance(value, Counted):
                given[name] = value.renamed(inner)
        given[df_] = df.select(*[F.col(k).alias(c) for k, c in inner.items()], F.col(t).alias("_when"), F.col(x).alias("_value"))
        given[keys_], given[t_], given[x_] = list(inner.values()), "_when", "_value"
        out = op(*bound.args, **bound.kwargs)
        back = {c: k for k, c in inner.items()} | {"_when": t}
        twice = [name for c, name in back.items() if c in out.columns and name in out.columns]
        if twice:
            raise ValueError(f"the result of {op.__name__} has columns {twice} of its own: rename the table's")
        return out.withColumnsRenamed(back)

    return run


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")


def observations(df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """Rows that are observations: key, time and first value present."""
    require(df, [*keys, t, *values])
    x = F.col(values[0]).cast("double")
    present = x.isNotNull() & ~F.isnan(x) & F.col(t).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    return df.where(present).select(
        *keys, t, *[F.col(v).cast("double").alias(v) for v in values]
    )


def pack(
    df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str],
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """One row per (series, block): keys, ``_block`` and ``obs``.

    ``obs`` holds the block's observations in time order as ``struct<t,
    values…>``.  Two rows of a series with the same time stop the job.
    """
    return checked(gathered(df, keys, t, values, blocking))


def gathered(df, keys, t, values, blocking) -> DataFrame:
    rows = observations(df, keys, t, values)
    obs = F.struct(F.col(t).alias("t"), *values)
    return (
        blocking.placed(rows, keys, t)
        # stated here so that every reader of this shuffle asks for the same rows
        .where(F.col(BLOCK).isNotNull())
        .groupBy(*keys, BLOCK)
        .agg(F.sort_array(F.collect_list(obs)).alias("obs"))
    )


def checked(packed: DataFrame) -> DataFrame:
    times = F.col("obs").getField("t")
    return packed.withColumn("obs", F.when(
        F.size(F.array_distinct(times)) < F.size("obs"),
        F.raise_error(F.lit("two observations of one series share a time")),
    ).otherwise(F.col("obs")))


def attach(packed: DataFrame, keys: Sequence[str], per_series: DataFrame) -> DataFrame:
    """Add per-series columns to blocks.

    The one-row-per-series table first meets the list of blocks, so the join
    with the data itself runs on (series, block): the data is neither shuffled
    again nor gathered by series, however uneven the series are.
    """
    index = packed.select(*keys, BLOCK).join(per_series, list(keys))
    return packed.hint("merge").join(index, [*keys, BLOCK])


def blocks(
    df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str],
    lags: int = 0, blocking: Blocking = DEFAULT, per_series: DataFrame | None = None,
) -> DataFrame:
    """``pack`` plus what a block needs to know about the rest of its series.

    Adds ``halo`` (the up to ``lags`` observations before the block), ``start``
    (observations before the block), ``nth`` (blocks before it), ``n`` and ``mean``
    (length of the series, mean of the first value).  Columns of ``per_series``, one row per series,
    travel with the summary; series it lacks are dropped.
    """
    keys = list(keys)
    packed = gathered(df, keys, t, values, blocking)
    size = F.size("obs")
    edges = packed.select(
        *keys, BLOCK, size.alias("_size"),
        F.expr(total(f"obs.`{values[0]}`")).alias("_sum"),
        F.slice("obs", F.greatest(size - lags + 1, F.lit(1)), max(lags, 1)).alias("_tail"),
    )
    series = Window.partitionBy(*keys)
    ordered = series.orderBy(BLOCK)
    before = F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    summary = edges.select(
        *keys, BLOCK,
        F.coalesce(before, F.lit(0)).cast("long").alias("start"),
        (F.row_number().over(ordered) - 1).alias("nth"),
        F.sum("_size").over(series).alias("n"),
        (F.sum("_sum").over(series) / F.sum("_size").over(series)).alias("mean"),
        *([F.lag("_tail").over(ordered).alias("_tail")] if lags else []),
    )
    more = []
    if per_series is not None:
        more = [c for c in per_series.columns if c not in keys]
        summary = summary.join(per_series, keys)
    if lags:
        # blocks that begin within the last `lags` observations: their preceding
        # tails, joined, end with the observations wanted (one tail, if blocks are full)
        near = series.orderBy("start").rangeBetween(-(lags - 1), 0)
        tails = F.flatten(F.collect_list("_tail").over(near))
        summary = summary.withColumn("_tails", tails).select(
            *keys, BLOCK, "start", "nth", "n", "mean", *more,
            F.expr(let("_tails", lambda a: f"slice({a}, greatest(size({a}) - {lags - 1}, 1), {lags})"))
            .alias("halo"),
        )
    return checked(packed).hint("merge").join(summary, [*keys, BLOCK])


def lag_name(value: str, k: int) -> str:
    return f"{value}_{k}"


def history(value: str, lags: int) -> str:
    """SQL: ``lags`` earlier values, then the block's own; NULLs where history ends."""
    own = f"obs.`{value}`"
    if not lags:
        return own
    return let(f"halo.`{value}`", lambda h: let(
        f"slice({h}, greatest(size({h}) - {lags - 1}, 1), {lags})",
        lambda near: f"concat(array_repeat(cast(null as double), {lags} - size({near})),"
                     f" {near}, {own})"))


def unblock(
    packed: DataFrame, keys: Sequence[str], t: str, values: Sequence[str],
    lags: dict[str, int] | None = None,
) -> DataFrame:
    """Back to one row per observation.

    Columns: keys, ``t``, ``pos`` (1…n), ``n``, ``mean``, the values and, for
    ``lags={"x": 3}``, the columns ``x_1 … x_3``.  Stays within the partitions
    of ``blocks``: no shuffle.
    """
    depth = {v: k for v, k in (lags or {}).items() if k}

    def rows(histories: dict[str, str]) -> str:
        def fields(o: str, i: str) -> str:
            pairs = [(t, f"{o}.t"), ("pos", f"start + {i} + 1")]
            pairs += [(v, f"{o}.`{v}`") for v in values]
            pairs += [(lag_name(v, k), f"get({histories[v]}, {i} + {depth[v] - k})")
                      for v in depth for k in range(1, depth[v] + 1)]
            return f"named_struct({', '.join(f'{name!r}, {value}' for name, value in pairs)})"

        return each_at("obs", fields)

    def bind(names: list[str], bound: dict[str, str]) -> str:
        if not names:
            return rows(bound)
        head, *rest = names
        return let(history(head, depth[head]), lambda h: bind(rest, {**bound, head: h}))

    return packed.select(*keys, "n", "mean", F.expr(f"inline({bind(list(depth), {})})"))


def lagged(
    df: DataFrame, keys: Sequence[str], t: str, x: str, k: int,
    blocking: Blocking = DEFAULT,
) -> DataFrame:
    """Observation lags ``x_1 … x_k`` beside each observation, any series length."""
    return unblock(blocks(df, keys, t, [x], k, blocking), keys, t, [x], {x: k})
