"""Preparing price tables: project, filter, rename, stack, tidy, clock changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import require


def series_select(
    df: DataFrame, keys: Sequence[str], t: str, x: str,
    load_step: str | None = None, step_column: str = "load_step",
) -> DataFrame:
    """The measure of one load step as ``(keys, t, x)``.

    The row filter comes before any lag: a lag is the previous *kept* row.
    """
    require(df, [*keys, t, x] + ([step_column] if load_step else []))
    kept = df.where(F.col(step_column) == load_step) if load_step else df
    return kept.select(*keys, t, F.col(x).cast("double").alias("x"))


def period_filter(df: DataFrame, t: str, first: date, last: date) -> DataFrame:
    """Rows from ``first`` to ``last``, both days whole.

    Plain comparisons with literals, so the scan can skip files and row groups.
    """
    require(df, [t])
    kind = df.schema[t].dataType
    after = last + timedelta(days=1)
    return df.where(
        (F.col(t) >= F.lit(first.isoformat()).cast(kind))
        & (F.col(t) < F.lit(after.isoformat()).cast(kind))
    )


def harmonise_union(
    frames: Sequence[DataFrame], renames: Sequence[Mapping[str, str]],
) -> DataFrame:
    """Stack yearly tables by column name after renaming; duplicates stay."""
    if not frames or len(frames) != len(renames):
        raise ValueError("one rename map per frame is needed")
    named = [f.withColumnsRenamed(dict(m)) for f, m in zip(frames, renames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def tidy_unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str],
    series: str = "series", x: str = "x",
) -> DataFrame:
    """Wide table (one column per series) to long rows."""
    require(df, [*ids, *values])
    return df.unpivot(list(ids), list(values), series, x)


def dst_adjust(
    df: DataFrame, t: str, edges: DataFrame, edge_column: str = "edge_ts",
) -> DataFrame:
    """Add 30 minutes at the hours in which daylight-saving time starts or ends.

    ``edges`` lists those hours.  No broadcast hint: Spark sends the table to
    every task only while it is below its own size limit.
    """
    require(df, [t])
    hits = edges.select(F.col(edge_column).alias("_edge")).distinct()
    moved = F.when(
        F.col("_edge").isNotNull(), F.col(t) + F.expr("INTERVAL 30 MINUTES")
    ).otherwise(F.col(t))
    return df.join(hits, F.col(t) == F.col("_edge"), "left").withColumn(t, moved).drop("_edge")
