"""Joining hourly prices with calendars and with the weekly price."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import require
from .prep import dst_adjust, harmonise_union


def operating_week(day: Column) -> Column:
    """Saturday on or before ``day``: operating weeks run Saturday to Friday."""
    return F.date_sub(day, F.dayofweek(day) % 7)


DAY_TYPES = ("weekday", "weekend", "holiday")


def step_table(load_steps: DataFrame) -> DataFrame:
    """One load step per day type and hour: at most 72 rows, whatever comes in.

    Two different steps for one hour of a day type stop the job, as do an
    unknown day type and an hour that is not one of 0 to 23.
    """
    require(load_steps, ["day_type", "hour", "load_step"])
    clash = F.min("load_step") != F.max("load_step")
    known = F.coalesce(F.col("day_type").isin(*DAY_TYPES) & F.col("hour").isin(*range(24)), F.lit(False))
    stop = F.raise_error(F.concat(
        F.lit("load steps have an unknown day type or hour: "),
        F.to_json(F.struct("day_type", "hour"))))
    return (
        load_steps.withColumn("day_type", F.when(known, F.col("day_type")).otherwise(stop.cast("string")))
        .groupBy("day_type", F.col("hour").cast("int").alias("_hour"))
        .agg(F.when(clash, F.raise_error(F.lit("an hour has two load steps")))
             .otherwise(F.min("load_step")).alias("load_step"))
    )


def load_step_join(
    hourly: DataFrame, t: str, holidays: DataFrame, load_steps: DataFrame,
) -> DataFrame:
    """Attach ``day_type`` and ``load_step`` to each hour; every hour stays.

    ``holidays(d)``; ``load_steps(day_type, hour, load_step)`` with day types
    weekday, weekend and holiday.  A holiday on a weekend is a holiday.  The
    step table cannot exceed 72 rows and is broadcast; holidays are left to
    Spark's own size check.
    """
    require(hourly, [t])
    require(holidays, ["d"])
    off = holidays.select(F.col("d").alias("_holiday")).distinct()
    day_type = (
        F.when(F.col("_holiday").isNotNull(), "holiday")
        .when(F.dayofweek("_day").isin(1, 7), "weekend").otherwise("weekday"))
    return (
        hourly.withColumn("_day", F.to_date(t))
        .join(off, F.col("_day") == F.col("_holiday"), "left")
        .withColumns({"day_type": day_type, "_hour": F.hour(t)})
        .join(F.broadcast(step_table(load_steps)), ["day_type", "_hour"], "left")
        .drop("_day", "_holiday", "_hour")
    )


#: How long a calendar row holds if no other follows, and how far an adjusted row may lie behind its hour.
HOLDS, SHIFTED = "1 day", "30 minutes"


def load_step_calendar(
    tables: Sequence[DataFrame], renames: Sequence[Mapping[str, str]], dst_edges: DataFrame,
    keys: Sequence[str] = (), edge_column: str = "edge_ts",
) -> DataFrame:
    """One calendar ``(keys, ts, load_step)`` from yearly tables with a time column.

    Each table's columns are renamed to ``ts`` and ``load_step``, its times read
    as local time, and 30 minutes added at the hours in which daylight-saving
    time starts or ends; then the tables are stacked.  Years may classify one
    and the same hour of the day differently.  Rows without a time are left out,
    repeated rows count once; two steps at one time stop the job.
    """
    ready = []
    for table, names in zip(tables, renames, strict=True):
        named = table.withColumnsRenamed(dict(names))
        require(named, [*keys, "ts", "load_step"])
        local = named.select(*keys, F.col("ts").cast("timestamp_ntz").alias("ts"), "load_step")
        ready.append(dst_adjust(local.where(F.col("ts").isNotNull()), "ts", dst_edges, edge_column))
    clash = F.min("load_step") != F.max("load_step")
    return harmonise_union(ready, [{}] * len(ready)).groupBy(*keys, "ts").agg(
        F.when(clash, F.raise_error(F.lit("a time has two load steps")).cast("string"))
        .otherwise(F.min("load_step")).alias("load_step"))


def calendar_join(
    hourly: DataFrame, t: str, calendar: DataFrame, keys: Sequence[str] = (),
    shifted: str = SHIFTED, holds: str = HOLDS,
) -> DataFrame:
    """Attach the ``load_step`` in force to each hour; every hour stays.

    That is the step of the latest calendar row no later than ``shifted`` after
    the hour, so the row of an hour that was moved by half an hour still is that
    hour's own.  A row holds until the next one, at most for ``holds``; hours
    without one, or without a time, have NULL.

    Rows meet by day: a day's entries, with those of the days before that may
    still hold, are one small sorted list (a year has 365 of them), which an
    hour looks up by its own day.  No series is sorted, and no hour meets more
    than its day's entries.
    """
    keys = list(keys)
    require(hourly, [*keys, t])
    require(calendar, [*keys, "ts", "load_step"])
    span = F.expr(f"INTERVAL {holds}")
    entry = F.col("ts").cast("timestamp_ntz")
    days = (
        calendar.where(F.col("ts").isNotNull())
        .select(*keys, F.struct(entry.alias("ts"), F.col("load_step").alias("step")).alias("_entry"))
        .withColumn("_day", F.explode(F.sequence(
            F.to_date("_entry.ts"), F.to_date(F.col("_entry.ts") + span), F.expr("INTERVAL 1 DAY"))))
        .groupBy(*keys, "_day").agg(F.sort_array(F.collect_set("_entry")).alias("_entries"))
    )
    last = (F.col(t).cast("timestamp_ntz") + F.expr(f"INTERVAL {shifted}")).alias("_last")
    rows = hourly.select("*", last).withColumn("_day", F.to_date("_last"))
    held = F.filter("_entries", lambda e: (e["ts"] <= F.col("_last")) & (e["ts"] > F.col("_last") - span))
    return rows.join(days, [*keys, "_day"], "left").withColumn(
        "load_step", F.try_element_at(held, F.lit(-1))["step"]).select(*hourly.columns, "load_step")


def weekly_hourly_align(
    hourly: DataFrame, weekly: DataFrame, keys: Sequence[str], t: str,
    hourly_price: str = "price", weekly_price: str = "price", pub_date: str = "pub_date",
    step_column: str | None = "load_step",
) -> DataFrame:
    """Each hourly price beside the weekly price published for its week.

    A weekly price published on a Friday holds for the operating week starting
    the next day.  Of several publications for one week the latest counts; rows
    without a price are no publication, and two prices on one day stop the job.
    Result: keys, step, ``t``, ``op_week``, ``hourly``, ``weekly`` (NULL when
    nothing was published).  The join key includes the week, so a series with
    many hours is spread over its weeks.
    """
    on = [*keys, *([step_column] if step_column else []), "op_week"]
    require(hourly, [*on[:-1], t, hourly_price])
    require(weekly, [*on[:-1], pub_date, weekly_price])
    price = F.col(weekly_price).cast("double")
    highest = F.max_by(price, F.struct(F.col(pub_date), price))
    lowest = F.max_by(price, F.struct(F.col(pub_date), -price))
    published = (
        weekly.where(price.isNotNull() & ~F.isnan(price) & F.col(pub_date).isNotNull())
        .withColumn("op_week", F.next_day(pub_date, "SAT"))
        .groupBy(*on)
        .agg(F.when(highest != lowest, F.raise_error(F.lit("two weekly prices on one day")).cast("double"))
             .otherwise(highest).alias("weekly"))
    )
    return (
        hourly.select(
            *on[:-1], t, operating_week(F.to_date(t)).alias("op_week"),
            F.col(hourly_price).cast("double").alias("hourly"),
        )
        .join(published, on, "left")
        .select(*on[:-1], t, "op_week", "hourly", "weekly")
    )


def weekly_hourly_diff(aligned: DataFrame, t: str) -> DataFrame:
    """Hourly minus weekly price per matched hour.

    ``issue_date`` is the day before delivery, when the hourly price is issued.
    """
    require(aligned, [t, "hourly", "weekly"])
    return (
        aligned.where(F.col("weekly").isNotNull())
        .withColumn("issue_date", F.date_sub(F.to_date(t), 1))
        .withColumn("diff", F.col("hourly") - F.col("weekly"))
    )
