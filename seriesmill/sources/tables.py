"""Files in, prepared data set out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.align import operating_week
from ..operators.blocks import require

FORMATS = ("parquet", "csv", "orc", "json")


def read_series(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read yearly tables.  Text formats need a schema: nothing is inferred.

    With a schema, a file's column that does not convert stops the job.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"{fmt} files need a schema")
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return reader.format(fmt).load(paths)


def write_prepared(
    df: DataFrame, path: str, week: str = "op_week", mode: str = "errorifexists",
) -> None:
    """Write the prepared table as Parquet, one folder per operating week.

    Rows are brought together by week before writing, so a week is a few files
    and readers that filter on the week skip the rest.  Spark splits a week too
    big for one task (the rebalance hint).
    """
    require(df, [week])
    df.hint("rebalance", week).write.mode(mode).partitionBy(week).parquet(path)


def touched_weeks(hourly: DataFrame, weekly: DataFrame, t: str = "ts", pub_date: str = "pub_date") -> DataFrame:
    """Operating weeks (``op_week``) that new rows bear on: those of the hours, and those that follow a
    publication, so a late one counts for the week it was meant for."""
    require(hourly, [t])
    require(weekly, [pub_date])
    hours = hourly.select(operating_week(F.to_date(t)).alias("op_week"))
    published = weekly.select(F.next_day(pub_date, "SAT").alias("op_week"))
    return hours.unionByName(published).where(F.col("op_week").isNotNull()).distinct()


def update_prepared(df: DataFrame, path: str, weeks: DataFrame, week: str = "op_week") -> None:
    """Write the rows of ``weeks`` anew and leave the files of all other weeks as they are.

    ``df`` is the prepared table, lazily over all data: only rows of the weeks
    listed are computed to the end and written.  Each week's folder is replaced
    as a whole (dynamic partition overwrite) when the job commits, so a rerun
    gives the same table.  The table need not exist yet.  A listed week without
    rows keeps the folder it may have.
    """
    require(df, [week])
    require(weeks, [week])
    rows = df.join(weeks.select(week).distinct(), week, "left_semi")
    rows.hint("rebalance", week).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        week).parquet(path)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Read back what ``write_prepared`` wrote; filters on the week prune folders."""
    return spark.read.parquet(path)
