"""Gapless positions in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Bits that hold a row's place within its partition in ``monotonically_increasing_id``.
PLACE = 33


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based place in ``order``, written to the shared folder.

    One exchange by ranges, a sort within each range, and the sizes of the
    ranges (one number per partition) summed up on the driver.  Rows that agree
    in the whole order get consecutive places in any order.
    """
    spark = df.sparkSession
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", PLACE), F.col("__at").bitwiseAND(F.lit((1 << PLACE) - 1))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "__part long, __before long")
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + place).drop("__at", "__part", "__before"))
