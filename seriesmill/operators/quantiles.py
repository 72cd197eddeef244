"""Exact quantiles and distribution functions without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import SENT, per_group, stored

# shares of a group by which a bracket may reach beyond its quantile
MARGINS = (0.1, 0.003)
#: Rows that a bracket may hold when its values are ranked, and marks by which a fuller one is narrowed.
HELD, GRID = 100_000, 500


def exact_quantiles(
    values: DataFrame, keys: Sequence[str], probs: Sequence[float],
    accuracy: int = 10_000, more: Sequence[Column] = (), held: int = HELD,
) -> DataFrame:
    """Per group of ``values(keys, v)``: ``n``, ``min``, ``max`` and ``q``, linearly interpolated quantiles.

    ``more`` are further aggregates over the value ``v``, taken in the first pass.

    Spark's ``percentile`` keeps every distinct value of a group in one task.
    Here a mergeable sketch first brackets each quantile; its rank error is at
    most n/accuracy, so a bracket some ranks wider surely holds the wanted
    ones.  A second pass counts the values below and ranks only those inside.
    The margin around a quantile is a share of the group, the smallest that
    still spans the ranks needed; tiny groups are bracketed by minimum and
    maximum.  A bracket with more than ``held`` rows between its ends, as large
    groups have, is narrowed first (``_narrowed``), so no more than those are
    ranked in a task.  All but the last pass run when this is called; rows are
    never exchanged but as counts of values inside a bracket.
    """
    keys = list(keys)
    margins = sorted({m for m in MARGINS if m > 4 / accuracy} | {4 / accuracy})
    marks = [m for p in probs for w in margins for m in (max(p - w, 0.0), min(p + w, 1.0))]
    sketch = values.groupBy(*keys).agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile_approx("v", marks, accuracy).alias("marks"), *more,
    )

    def bracket(i: int) -> Column:
        lo, hi = F.col("min"), F.col("max")
        for at, w in reversed(list(enumerate(margins))):
            enough = F.col("n") * (w - 1 / accuracy) >= 3
            place = 2 * (i * len(margins) + at)
            lo = F.when(enough, F.col("marks")[place]).otherwise(lo)
            hi = F.when(enough, F.col("marks")[place + 1]).otherwise(hi)
        return F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"), F.col("n").alias("all"))

    groups = stored(sketch.withColumn("brackets", F.array(*[bracket(i) for i in range(len(probs))])).drop("marks"))
    count, fullest = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    # a bracket reaches at most 4 / accuracy and the sketch's error to both sides, or its group is small
    if count and fullest > held and (accuracy > held or fullest * 10 / accuracy > held):
        groups = per_group(_narrowed(values, keys, groups, probs, max(accuracy, 20 * GRID), held))
    elif count <= SENT:
        groups = F.broadcast(groups)
    inside = (
        values.join(groups.select(*keys, "brackets"), keys)
        .select(*keys, "v", F.explode(F.filter("brackets", lambda b: F.col("v") <= b["hi"])).alias("b"))
        # one NULL stands for all values below the bracket
        .select(*keys, "b.i", "b.all", F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("v"))
        .groupBy(*keys, "i", "all", "v").agg(F.count(F.lit(1)).alias("_count"))
    )
    up_to = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    p, low = _place(probs, "i", "all")
    value = F.coalesce("v", F.lit(float("-inf")))
    ranked = (
        inside.withColumns({"_rank": F.sum("_count").over(up_to), "_low": low})
        .groupBy(*keys, "i", "all")
        .agg(
            F.min(F.when(F.col("_rank") > F.col("_low"), value)).alias("a"),
            F.min(F.when(F.col("_rank") >= F.least(F.col("_low") + 2, F.col("all")), value)).alias("b"),
        )
    )
    missed = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == float("-inf"))
    between = (F.col("all") - 1) * p - low
    quantile = F.when(missed, F.raise_error(F.lit("quantile outside its bracket"))).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * between)
    found = (
        ranked.select(*keys, F.struct("i", quantile.alias("q")).alias("_q"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list("_q")).alias("_q"))
    )
    return found.join(groups.drop("brackets"), keys).withColumn("q", F.col("_q.q")).drop("_q")


def _place(probs: Sequence[float], i: str, n: str) -> tuple[Column, Column]:
    """The share of a bracket's quantile and the 0-based rank at or below it."""
    p = F.element_at(F.array(*[F.lit(float(v)) for v in probs]), F.col(i) + 1)
    return p, F.floor((F.col(n) - 1) * p)


def _narrowed(
    values: DataFrame, keys: list[str], groups: DataFrame, probs: Sequence[float], accuracy: int, held: int,
) -> DataFrame:
    """``groups`` with brackets that hold at most ``held`` rows strictly between their ends.

    Each round reads the rows inside the brackets that may be too full, counts
    how many lie below, at the ends and between, and sketches those between by
    ``GRID`` marks.  The wanted ranks are then at an end, which closes the
    bracket, or between two marks nearby: about one row in a hundred is left.
    Values that fill a bracket by their number become its ends, which are
    counted and not kept.
    """
    open_ = stored(groups.select(*keys, "n", F.inline("brackets")).select(*keys, "i", "all", "lo", "hi"))
    done, step = [], F.lit(1.0) / GRID
    marks = [k / GRID for k in range(GRID + 1)]
    for _ in range(64):
        v = F.col("v")
        between = (v > F.col("lo")) & (v < F.col("hi"))
        wanted = per_group(open_.groupBy(*keys).agg(F.collect_list(F.struct("i", "all", "lo", "hi")).alias("_open")))
        counted = (
            values.join(wanted, keys)
            .select(*keys, "v", F.explode(F.filter("_open", lambda b: F.col("v") <= b["hi"])).alias("_b"))
            .select(*keys, "v", "_b.*").groupBy(*keys, "i", "all", "lo", "hi").agg(
                F.count(F.when(v < F.col("lo"), 1)).alias("_below"), F.count(F.when(v == F.col("lo"), 1)).alias("_at"),
                F.count(F.when(between, 1)).alias("_mid"),
                F.percentile_approx(F.when(between, v), marks, accuracy).alias("_marks")))
        counted = stored(counted)
        done.append(counted.where(F.col("_mid") <= held).select(*keys, "i", "all", "lo", "hi"))
        full = counted.where(F.col("_mid") > held)
        if full.isEmpty():
            break
        _, low = _place(probs, "i", "all")
        first = low - F.col("_below") - F.col("_at")
        last = F.least(low + 1, F.col("all") - 1) - F.col("_below") - F.col("_at")
        left = F.floor(first / F.col("_mid") / step).cast("int") - 2
        right = F.ceil(last / F.col("_mid") / step).cast("int") + 2
        lo = F.when(last < 0, F.col("lo")).when(first >= F.col("_mid"), F.col("hi")).when(
            left < 0, F.col("lo")).otherwise(F.get("_marks", left))
        hi = F.when(last < 0, F.col("lo")).when(first >= F.col("_mid"), F.col("hi")).when(
            right > GRID, F.col("hi")).otherwise(F.get("_marks", right))
        open_ = stored(full.select(*keys, "i", "all", lo.alias("lo"), hi.alias("hi")))
    else:
        raise RuntimeError("a bracket of a quantile did not narrow")
    found = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("i", "lo", "hi", "all"))).alias("brackets"))
    return groups.drop("brackets").join(found, keys)


def ecdf(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Empirical distribution function of ``values(keys, value)``: ``(keys, value, n, cum, ecdf)``.

    Equal values collapse first, before the exchange.  What is left is dealt by
    ranges of (keys, value), so a large group spreads over as many ranges as it
    needs; ranking happens within a range, and the counts of lower ranges are
    added.  The ranges are written to the shared folder when this is called.
    """
    keys = list(keys)
    counts = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.repartitionByRange(*keys, "value").withColumn("_piece", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    offsets = counts.groupBy(*keys, "_piece").agg(F.sum("n").alias("_in")).select(
        *keys, "_piece",
        (F.sum("_in").over(group.orderBy("_piece")) - F.col("_in")).alias("_below"),
        F.sum("_in").over(group).alias("_all"),
    )
    within = Window.partitionBy(*keys, "_piece").orderBy("value")
    return (
        counts.withColumn("_cum", F.sum("n").over(within))
        .join(offsets, [*keys, "_piece"])
        .select(*keys, "value", "n", (F.col("_below") + F.col("_cum")).alias("cum"),
                ((F.col("_below") + F.col("_cum")) / F.col("_all")).alias("ecdf"))
    )
