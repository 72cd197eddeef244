"""Blocks with counted bounds: sizes, numbers, order, and operators on top of them."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmill.operators.blocks import BLOCK, Blocking, Counted, blocks, counted_blocking, lagged
from seriesmill.operators.diagnostics import ljung_box

K = ["series"]
START = datetime(2020, 1, 1)


def spaced(spark):
    """Series of very different spacing in one table; the last two are as uneven as it gets."""
    steps = {"ms": (6000, timedelta(milliseconds=1)), "second": (3000, timedelta(seconds=1)),
             "day": (2500, timedelta(days=1)), "week": (4000, timedelta(weeks=1)), "one": (1, timedelta(days=1))}
    rows = [(k, START + i * step, float(i % 97)) for k, (n, step) in steps.items() for i in range(n)]
    rows += [("burst", START + timedelta(microseconds=i), float(i % 89)) for i in range(3000)]
    rows += [("burst", datetime(2090, 1, 1) + timedelta(days=i), 1.0) for i in range(3)]
    draw = np.random.default_rng(0)
    at = sorted({int(v) for v in np.exp(draw.uniform(0, 34, 4000))})
    rows += [("growing", START + timedelta(microseconds=v), float(i % 83)) for i, v in enumerate(at)]
    return spark.createDataFrame(rows, "series string, t timestamp_ntz, x double").repartition(8)


@pytest.mark.parametrize("rows", [64, 500])
def test_no_block_is_too_large_and_none_too_many(spark, rows):
    df = spaced(spark)
    blocking = counted_blocking(df, K, "t", rows)
    assert isinstance(blocking, Counted) and len(blocking.splits) > 1
    placed = blocking.placed(df, K, "t").groupBy(*K, BLOCK).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).collect()
    per = {}
    for r in placed:
        per.setdefault(r["series"], []).append((r[BLOCK], r["first"], r["last"], r["n"]))
    for found in per.values():
        found.sort()
        n = sum(f[3] for f in found)
        assert max(f[3] for f in found) <= rows
        assert len(found) <= 2 * n / rows + 2
        # blocks follow each other in time
        assert all(a[2] < b[1] for a, b in zip(found, found[1:]))


def test_results_do_not_depend_on_blocks(spark):
    df = spaced(spark)
    order = Window.partitionBy("series").orderBy("t")
    want = df.select("series", "t", F.row_number().over(order).alias("pos"), "x", F.lag("x", 2).over(order).alias("x_2"))
    found = lagged(df, K, "t", "x", 2, Blocking(rows=100)).select("series", "t", "pos", "x", "x_2")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    one = {r["series"]: r for r in ljung_box(df, K, "t", "x", blocking=Blocking(rows=1_000_000, grain=3600)).collect()}
    for r in ljung_box(df, K, "t", "x", blocking=Blocking(rows=100)).collect():
        q = one[r["series"]]["q"]
        assert r["q"] == pytest.approx(q, rel=1e-9) if q is not None else r["q"] is None


def test_even_data_need_no_bounds(spark):
    hours = spark.createDataFrame([("a", START + timedelta(hours=i), 1.0) for i in range(500)],
                                  "series string, t timestamp_ntz, x double")
    assert counted_blocking(hours, K, "t", 100) == Blocking(100, 3600)
    assert counted_blocking(hours.limit(0), K, "t", 100) == Blocking(100, 3600)
    assert blocks(hours.limit(0), K, "t", ["x"]).isEmpty()


@pytest.mark.parametrize("kind, at", [
    ("date", lambda i: date(1900, 1, 1) + timedelta(days=i * i)), ("long", lambda i: i * 3_600_000_000 - 10**12),
    ("timestamp", lambda i: START + timedelta(seconds=i))])
def test_kinds_of_time(spark, kind, at):
    df = spark.createDataFrame([("a", at(i), float(i)) for i in range(200)], f"series string, t {kind}, x double")
    found = blocks(df, K, "t", ["x"], 1, Blocking(rows=16)).select(F.size("obs").alias("n"), "start", "nth").collect()
    assert max(r["n"] for r in found) <= 16 and len(found) <= 27
    assert [r["nth"] for r in sorted(found, key=lambda r: r["start"])] == list(range(len(found)))


def test_bounds_hold_for_what_was_counted(spark):
    df = spaced(spark)
    blocking = counted_blocking(df, K, "t", 100)
    some = df.where("series = 'week' AND x > 3")
    assert lagged(some, K, "t", "x", 1, blocking).count() == some.count()
    later = spark.createDataFrame([("week", datetime(2200, 1, 1), 1.0)], "series string, t timestamp_ntz, x double")
    with pytest.raises(Exception, match="when blocks were counted"):
        lagged(later, K, "t", "x", 1, blocking).collect()
    with pytest.raises(Exception, match="when blocks were counted"):
        lagged(later.withColumn("series", F.lit("new")), K, "t", "x", 1, blocking).collect()


def test_equal_times_still_stop_the_job(spark):
    rows = [("a", START, float(i)) for i in range(50)] + [("a", START + timedelta(weeks=i + 1), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "series string, t timestamp_ntz, x double")
    with pytest.raises(Exception, match="share a time"):
        lagged(df, K, "t", "x", 1, Blocking(rows=10)).collect()


def test_many_small_series(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("series"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    placed = Blocking(rows=64).placed(df, K, "t").groupBy(*K, BLOCK).count()
    # four rows of a series, far apart at the usual spacing, are one or two blocks
    assert placed.groupBy("series").count().agg(F.max("count")).first()[0] <= 2


def test_columns_of_any_name(spark):
    """Names that operators use inside, as key, time or value."""
    from seriesmill.operators.arma import Arma, arma_fit_hr, arma_residuals
    from seriesmill.operators.derive import cc_returns
    from seriesmill.operators.diagnostics import acf
    draw = np.random.default_rng(1)
    plain = spark.createDataFrame(
        [("ab"[i % 2], i, float(v)) for i, v in enumerate(draw.uniform(1, 2, 120))], "series string, t long, x double")

    def rows(df, order):
        return [tuple(r) for r in df.orderBy(*order).collect()]

    want = rows(ljung_box(plain, K, "t", "x", 5), ["series"])
    for name in ("mean", "n", "obs", "pos", "c"):
        assert rows(ljung_box(plain.withColumnRenamed("x", name), K, "t", name, 5), ["series"]) == want
    assert rows(cc_returns(plain.withColumnRenamed("x", "n"), K, "t", "n"), ["series", "t"]) == rows(
        cc_returns(plain, K, "t", "x"), ["series", "t"])
    named = plain.withColumnsRenamed({"series": "n", "t": "start", "x": "mean"})
    found = acf(named, ["n"], "start", "mean", 3)
    assert found.columns[0] == "n" and rows(found, ["n", "lag"]) == rows(acf(plain, K, "t", "x", 3), ["series", "lag"])
    found = arma_residuals(named, ["n"], "start", "mean", Arma((0.5,), (0.2,)))
    assert found.columns == ["n", "start", "x", "fitted", "resid"]
    assert rows(found, ["n", "start"]) == rows(arma_residuals(plain, K, "t", "x", Arma((0.5,), (0.2,))), ["series", "t"])
    model = arma_fit_hr(plain, K, "t", "x", 1, 1)
    found = arma_residuals(plain.withColumnRenamed("x", "obs"), K, "t", "obs", model)
    assert rows(found, ["series", "t"]) == rows(arma_residuals(plain, K, "t", "x", model), ["series", "t"])
    with pytest.raises(ValueError, match="of its own"):
        ljung_box(named, ["n"], "start", "mean", 5)
