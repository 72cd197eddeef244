"""One query per operator, run on whole test tables.

The test tables hold no prices, so they stand in: the hourly price of a series
is the hourly sum of ``events.value`` per event type; daily series come from
``orders`` (per priority) and ``lineitem`` (per supplier).  Times leave as text
and doubles rounded, so both engines print the same value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.operators import arma, diagnostics, forecast
from seriesmill.operators.align import (
    calendar_join, load_step_calendar, load_step_join, weekly_hourly_align, weekly_hourly_diff,
)
from seriesmill.operators.arma import Arma
from seriesmill.operators.blocks import Blocking, lagged
from seriesmill.operators.derive import (
    cc_returns, frac_diff, holdout, series_tail, train_holdout_split,
)
from seriesmill.operators.prep import (
    dst_adjust, harmonise_union, period_filter, series_select, tidy_unpivot,
)
from seriesmill.plans.lifecycle import prepare
from seriesmill.sources.views import analysis_views
from seriesmill.session import shared_folder
from seriesmill.sources.tables import read_prepared, read_series, touched_weeks, update_prepared, write_prepared

SERIES = ["series"]
#: Four days of hours per block: the hourly series have dozens of blocks each.
SHORT = Blocking(rows=96)
#: Fits and searches go over series that are known to be hourly: nothing is counted.
HOURS = Blocking(grain=3600)
MODEL = Arma(phi=(0.5, -0.2, 0.1), theta=(0.6,))
YEARS = range(1995, 2002)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_series(spark, f"{sf}/{name}.parquet")


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 printed as 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def as_text(c: str) -> Column:
    """A date or time to the second, whatever the session time zone."""
    return F.substring(F.col(c).cast("timestamp_ntz").cast("string"), 1, 19)


def show(df: DataFrame, *columns: str, text: tuple[str, ...] = (), **digits: int) -> DataFrame:
    """Plain columns, times as text, doubles rounded to the given digits."""
    return df.select(
        *columns,
        *[as_text(c).alias(c) for c in text],
        *[rounded(c, d).alias(c) for c, d in digits.items()],
    )


# ---- stand-ins -----------------------------------------------------------------

def hourly(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.window("ts", "1 hour")["start"]
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series"), hour.alias("ts"))
        .agg(F.round(F.sum("value"), 2).alias("price"))
    )


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    )


def daily_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("series"), F.to_date("l_shipdate").alias("day"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    )


def load_steps(spark: SparkSession) -> DataFrame:
    """Every hour of the three day types."""
    hour, kind = F.col("id") % 24, F.floor(F.col("id") / 24)
    day_type = F.when(kind == 0, "weekday").when(kind == 1, "weekend").otherwise("holiday")
    step = (
        F.when(hour < F.when(kind == 0, 7).when(kind == 1, 17).otherwise(18), "light")
        .when((kind == 0) & hour.between(17, 20), "heavy").otherwise("medium")
    )
    return spark.range(72).select(
        day_type.alias("day_type"), hour.cast("int").alias("hour"), step.alias("load_step"))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES (DATE'2024-01-01'), (DATE'2024-01-15'), (DATE'2024-01-20') AS h(d)")


def dst_edges(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-07 00:00:00', 'start'),"
        " (TIMESTAMP_NTZ'2024-01-21 03:00:00', 'end') AS e(edge_ts, kind)")


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return load_step_join(hourly(spark, sf), "ts", holidays(spark), load_steps(spark))


#: Days on which yearly load-step tables begin; columns and hours of the steps change with them.
CALENDARS = (("1900-01-01", "instante", "patamar", 7, 17), ("2024-01-16", "hora", "step", 8, 18))


def calendar_tables(spark: SparkSession, sf: str) -> tuple[list[DataFrame], list[dict[str, str]]]:
    """Load-step tables with a row every three hours, each with its own columns; the second has times as text."""
    hours = hourly(spark, sf).select("ts").distinct().where(F.hour("ts") % 3 == 0)
    tables, renames = [], []
    ends = [first for first, *_ in CALENDARS[1:]] + ["9999-01-01"]
    for (first, time, step, light, heavy), end in zip(CALENDARS, ends):
        kept = hours.where((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        named = F.when(F.hour("ts") < light, "light").when(F.hour("ts").between(heavy, heavy + 3), "heavy").otherwise("medium")
        stamp = F.col("ts") if time == "instante" else as_text("ts")
        tables.append(kept.select(stamp.alias(time), named.alias(step)))
        renames.append({time: "ts", step: "load_step"})
    return tables, renames


def stepped(spark: SparkSession, sf: str) -> DataFrame:
    """Prices with the step of the calendar."""
    return calendar_join(hourly(spark, sf), "ts", load_step_calendar(*calendar_tables(spark, sf), dst_edges(spark)))


def weekly(spark: SparkSession, sf: str, prices: DataFrame | None = None) -> DataFrame:
    """Average of each operating week, published on its Friday; a draft at half the price on Tuesday."""
    day = F.to_date("ts")
    past = (
        (classified(spark, sf) if prices is None else prices)
        .groupBy("series", "load_step", F.date_sub(day, F.dayofweek(day) % 7).alias("_week"))
        .agg(F.round(F.avg("price"), 4).alias("price"))
    )
    published = F.explode(F.array(*[
        F.struct(F.date_add("_week", after).alias("pub_date"), (F.col("price") / share).alias("price"))
        for after, share in ((6, 1), (3, 2))]))
    return past.select("series", "load_step", published.alias("_out")).select("series", "load_step", "_out.*")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """One series each with a value every millisecond, second, day and week, in one table; two run backwards."""
    steps = {"ms": "1 millisecond", "second": "-1 second", "day": "1 day", "week": "-7 days"}
    at = F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"),
                 (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr(f"event_id * INTERVAL '{step}'")).alias("ts"))
        for name, step in steps.items()]))
    return table(spark, sf, "events").select(at.alias("_at"), F.round("value", 2).alias("price")).select("_at.*", "price")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_hourly_align(classified(spark, sf), weekly(spark, sf), SERIES, "ts")


def differences(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_hourly_diff(aligned(spark, sf), "ts")


def model_table(series: DataFrame, phi: tuple, theta: tuple) -> DataFrame:
    """The same coefficients for every series, centred on its own mean."""
    return series.groupBy("series").agg(F.avg("price").alias("mu")).select(
        "series", F.lit(len(phi)).alias("p"), F.lit(len(theta)).alias("q"), "mu",
        F.lit(True).alias("with_mean"), F.array(*[F.lit(c) for c in (*phi, *theta)]).alias("coef"))


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    """An ARMA(3,1) series: the hourly prices taken as its shocks.

    Inverting the filter is itself a residual recursion with the two
    polynomials exchanged.
    """
    prices = hourly(spark, sf)
    inverse = model_table(prices, (-0.6,), (-0.5, 0.2, -0.1))
    return (
        arma.arma_residuals(prices, SERIES, "ts", "price", inverse, 1, HOURS)
        .where(F.col("resid").isNotNull()).select("series", "ts", F.col("resid").alias("y"))
    )


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    prices = hourly(spark, sf)
    models = model_table(prices, MODEL.phi, MODEL.theta)
    return arma.arma_residuals(prices, SERIES, "ts", "price", models, 3, HOURS)


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    prices = hourly(spark, sf)
    return arma.arma_evaluate(
        prices, SERIES, "ts", "price", model_table(prices, MODEL.phi, MODEL.theta), 3, HOURS)


def split(spark: SparkSession, sf: str) -> DataFrame:
    return train_holdout_split(hourly(spark, sf), SERIES, "ts", "price", 3)


def train(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).where("sample = 'train'").select("series", "ts", "x")


def ahead(spark: SparkSession, sf: str) -> DataFrame:
    model = Arma(MODEL.phi, MODEL.theta, mu=145.0)
    return forecast.arma_forecast(train(spark, sf), SERIES, "ts", "x", model, h=3)


# ---- sources, projection, reshaping ------------------------------------------------

def scan_series(spark, sf):
    per = table(spark, sf, "events").groupBy(F.col("event_type").alias("series")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.sum("value").alias("total"))
    return show(per, "series", "n", text=("first", "last"), total=2)


def q_series_select(spark, sf):
    light = series_select(classified(spark, sf), SERIES, "ts", "price", "light")
    return show(light, "series", text=("ts",), x=2)


def q_period_filter(spark, sf):
    kept = period_filter(
        table(spark, sf, "orders"), "o_orderdate", date(1996, 4, 17), date(1998, 11, 6))
    return show(kept, "o_orderkey", text=("o_orderdate",), o_totalprice=2)


def q_harmonise_union(spark, sf):
    """Yearly tables whose price column carries the year; 1995 has no status."""
    frames, renames = [], []
    for year in YEARS:
        part = period_filter(
            table(spark, sf, "orders"), "o_orderdate", date(year, 1, 1), date(year, 12, 31)
        ).select("o_orderkey", F.col("o_totalprice").alias(f"price_{year}"),
                 *([] if year == YEARS[0] else ["o_orderstatus"]))
        frames.append(part)
        renames.append({f"price_{year}": "price", "o_orderstatus": "status"})
    stacked = harmonise_union(frames, renames).fillna("none", ["status"])
    return show(stacked, "o_orderkey", "status", price=2)


def q_tidy_unpivot(spark, sf):
    wide = (
        table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("day"))
        .agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"),
             F.sum("l_tax").alias("tax"))
    )
    return show(tidy_unpivot(wide, ["day"], ["quantity", "price", "tax"]), "series",
                text=("day",), x=2)


def q_dst_adjust(spark, sf):
    return show(dst_adjust(hourly(spark, sf), "ts", dst_edges(spark)), "series",
                text=("ts",), price=2)


# ---- joins ------------------------------------------------------------------------

def q_load_step_join(spark, sf):
    return show(classified(spark, sf), "series", "day_type", "load_step", text=("ts",), price=2)


def q_weekly_hourly_align(spark, sf):
    return show(aligned(spark, sf), "series", "load_step", text=("ts", "op_week"),
                hourly=2, weekly=4)


def q_weekly_hourly_diff(spark, sf):
    return show(differences(spark, sf), "series", "load_step", text=("ts", "issue_date"), diff=4)


def q_prepared(spark, sf):
    """The whole preparation, from two yearly load-step tables to the differences."""
    steps = load_steps(spark)
    night = steps.where("hour < 12").withColumnsRenamed({"hour": "hora", "load_step": "patamar"})
    noon = steps.where("hour >= 12")
    done = prepare(
        hourly(spark, sf), weekly(spark, sf), [night, noon],
        [{"hora": "hour", "patamar": "load_step"}, {}], holidays(spark), dst_edges(spark), SERIES)
    return show(done, "series", "load_step", text=("ts", "op_week", "issue_date"),
                hourly=2, weekly=4, diff=4)


def q_load_step_calendar(spark, sf):
    return show(load_step_calendar(*calendar_tables(spark, sf), dst_edges(spark)), "load_step", text=("ts",))


def q_calendar_join(spark, sf):
    return show(stepped(spark, sf), "series", "load_step", text=("ts",), price=2)


def q_prepared_calendar(spark, sf):
    """The whole preparation, from load-step tables with times to the differences."""
    tables, renames = calendar_tables(spark, sf)
    done = prepare(hourly(spark, sf), weekly(spark, sf, stepped(spark, sf)), tables, renames, None, dst_edges(spark), SERIES)
    return show(done, "series", "load_step", text=("ts", "op_week", "issue_date"), hourly=2, weekly=4, diff=4)


#: From here on hours and publications arrive late.
LATE = "2024-01-18"


def q_prepared_update(spark, sf):
    """The prepared table, first written without what arrives late, then brought up to date week by week."""
    prices, published, steps = hourly(spark, sf), weekly(spark, sf), load_steps(spark)

    def prepared(prices, published):
        return prepare(prices, published, [steps], [{}], holidays(spark), dst_edges(spark), SERIES)

    path = f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}"
    write_prepared(prepared(prices.where(F.col("ts") < LATE), published.where(F.col("pub_date") < LATE)), path)
    late = touched_weeks(prices.where(F.col("ts") >= LATE), published.where(F.col("pub_date") >= LATE))
    update_prepared(prepared(prices, published), path, late)
    return show(read_prepared(spark, path), "series", "load_step", text=("ts", "op_week", "issue_date"),
                hourly=2, weekly=4, diff=4)


# ---- derivation ---------------------------------------------------------------------

def q_lagged(spark, sf):
    rows = lagged(hourly(spark, sf), SERIES, "ts", "price", 3)
    return show(rows, "series", "pos", text=("ts",), price=2, price_1=2, price_3=2)


def q_cc_returns(spark, sf):
    return show(cc_returns(daily_orders(spark, sf), SERIES, "day", "price"), "series",
                text=("day",), ret=6)


def q_series_tail(spark, sf):
    tail = series_tail(daily_suppliers(spark, sf), SERIES, "day", "price", 10)
    return show(tail, "series", "pos", text=("day",), x=2)


def q_train_holdout_split(spark, sf):
    marked = split(spark, sf).withColumn("h", F.coalesce("h", F.lit(0)))
    return show(marked, "series", "sample", "h", text=("ts",), x=2)


def q_frac_diff(spark, sf):
    return show(frac_diff(daily_orders(spark, sf), SERIES, "day", "price", 0.00943, 50),
                "series", text=("day",), fd=4)


#: A memory of most of the daily series, which have dozens of blocks of 96 days.
MEMORY = 2000
THIRD = 1 / 3


def q_frac_diff_long(spark, sf):
    return show(frac_diff(daily_orders(spark, sf), SERIES, "day", "price", THIRD, MEMORY, SHORT),
                "series", text=("day",), fd=4)


# ---- diagnostics -----------------------------------------------------------------------

def q_sd_band(spark, sf):
    return show(diagnostics.sd_band(daily_suppliers(spark, sf), SERIES, "day", "price"),
                "series", "n", mean=4, sd=4, lower=4, upper=4)


def q_acf(spark, sf):
    return show(diagnostics.acf(hourly(spark, sf), SERIES, "ts", "price"), "series", "lag",
                rho=6, limit=6)


def q_ljung_box(spark, sf):
    test = diagnostics.ljung_box(hourly(spark, sf), SERIES, "ts", "price", 10, 6)
    return show(test, "series", "n", "df", q=6, p_value=6)


def q_ljung_box_suppliers(spark, sf):
    test = diagnostics.ljung_box(daily_suppliers(spark, sf), SERIES, "day", "price", 10, 4)
    return show(test, "series", "n", "df", q=6, p_value=6)


def q_fd_histogram(spark, sf):
    return show(diagnostics.fd_histogram(hourly(spark, sf), SERIES, "ts", "price"),
                "series", "bin", "n", lo=6, hi=6)


def q_diff_distribution(spark, sf):
    d = diagnostics.diff_distribution(differences(spark, sf), ["series", "load_step"], "ts")
    return show(d, "series", "load_step", "n", mean=6, sd=6, skewness=6, kurtosis=6, min=4, max=4,
                p05=6, p25=6, p50=6, p75=6, p95=6)


def q_diff_ecdf(spark, sf):
    d = differences(spark, sf).withColumn("diff", F.round("diff", 4))
    return show(diagnostics.diff_ecdf(d, ["series", "load_step"], "ts"),
                "series", "load_step", "n", "cum", value=4, ecdf=6)


# ---- from SQL -----------------------------------------------------------------------------

def views(spark: SparkSession, sf: str) -> str:
    """The hourly prices as a view, with the views of the operators beside it."""
    name = f"prices_{uuid.uuid4().hex}"
    hourly(spark, sf).createTempView(name)
    analysis_views(spark, name, SERIES, "ts", "price", lags=3, test_lags=10, fit_df=6)
    return name


def q_sql_ljung_box(spark, sf):
    return spark.sql(f"""
        SELECT series, n, df, round(q, 6) + 0D AS q, round(p_value, 6) + 0D AS p_value FROM {views(spark, sf)}_ljung_box""")


def q_sql_acf(spark, sf):
    return spark.sql(
        f"SELECT series, lag, round(rho, 6) + 0D AS rho, round(`limit`, 6) + 0D AS `limit` FROM {views(spark, sf)}_acf")


def q_sql_lagged(spark, sf):
    return spark.sql(f"""
        SELECT series, pos, substring(cast(ts AS string), 1, 19) AS ts, round(price, 2) + 0D AS price,
               round(price_1, 2) + 0D AS price_1, round(price_3, 2) + 0D AS price_3 FROM {views(spark, sf)}_lagged""")


# ---- residuals of a given model ------------------------------------------------------------

def known(df: DataFrame) -> DataFrame:
    return df.where(F.col("resid").isNotNull()).select("series", "ts", "resid")


def q_arma_residuals(spark, sf):
    return show(residuals(spark, sf), "series", text=("ts",), x=2, fitted=6, resid=6)


def q_accuracy(spark, sf):
    a = diagnostics.accuracy_measures(residuals(spark, sf), SERIES, "ts")
    return show(a, "series", me=6, rmse=6, mae=6, mpe=4, mape=4, mase=6, acf1=6)


def q_residual_ljung_box(spark, sf):
    test = diagnostics.ljung_box(known(residuals(spark, sf)), SERIES, "ts", "resid", 10, 6)
    return show(test, "series", "n", "df", q=6, p_value=6)


def q_residual_acf(spark, sf):
    return show(diagnostics.acf(known(residuals(spark, sf)), SERIES, "ts", "resid", 10),
                "series", "lag", rho=6, limit=6)


def q_residual_histogram(spark, sf):
    r = known(residuals(spark, sf)).withColumn("resid", F.round("resid", 4))
    return show(diagnostics.fd_histogram(r, SERIES, "ts", "resid"),
                "series", "bin", "n", lo=6, hi=6)


def q_arma_evaluate(spark, sf):
    return show(evaluated(spark, sf), "series", "n", "n_used", sse=2, sigma2=4, loglik=4, aic=4,
                aicc=4, bic=4)


def q_coef_table(spark, sf):
    return show(arma.coef_table(evaluated(spark, sf), SERIES), "series", "term", "significant",
                estimate=6, std_err=6, t_value=4, critical=6)


# ---- forecasts ----------------------------------------------------------------------------------

def q_arma_forecast(spark, sf):
    return show(ahead(spark, sf), "series", "h", mean=5, se=5, lower=5, upper=5)


def q_forecast_vs_actual(spark, sf):
    actual = holdout(hourly(spark, sf), SERIES, "ts", "price", 3)
    table_ = forecast.forecast_vs_actual(ahead(spark, sf), actual, SERIES)
    return show(table_, "series", "h", pred=5, actual=2, err=5, sq_err=3)


def q_forecast_chart_frame(spark, sf):
    actual = holdout(hourly(spark, sf), SERIES, "ts", "price", 3)
    frame = forecast.forecast_chart_frame(
        train(spark, sf), ahead(spark, sf), actual, SERIES, "ts", "x")
    return show(frame, "series", "pos", "label", value=5)


# ---- estimation and search ----------------------------------------------------------------------

def coefficients(df: DataFrame, digits: int = 4) -> DataFrame:
    """Coefficient arrays as rows: one line per term."""
    at, p = F.col("_at"), F.col("p")
    name = F.when(at < p, F.concat(F.lit("ar"), at + 1)).otherwise(
        F.concat(F.lit("ma"), at - p + 1))
    rows = df.select("*", F.posexplode("coef").alias("_at", "estimate"))
    return rows.select("series", name.alias("term"), rounded("estimate", digits).alias("estimate"))


def q_arma_fit_hr(spark, sf):
    return coefficients(arma.arma_fit_hr(filtered(spark, sf), SERIES, "ts", "y", 3, 1, blocking=HOURS))


def q_arma_fit_css(spark, sf):
    return css_columns(arma.arma_fit_css(filtered(spark, sf), SERIES, "ts", "y", 3, 1, blocking=HOURS))


def css_columns(fit: DataFrame) -> DataFrame:
    terms = {name: rounded(F.get("coef", F.lit(i)), 4) for i, name in enumerate(("ar1", "ar2", "ar3", "ma1"))}
    return show(fit.withColumns(terms), "series", "p", "q", "n", "n_used", "converged", *terms, sigma2=4, aicc=4)


def q_order_leaderboard(spark, sf):
    """Pure AR candidates, which are least-squares fits SQL can repeat."""
    board = arma.order_leaderboard(filtered(spark, sf), SERIES, "ts", "y", max_q=0, blocking=HOURS)
    return show(board, "series", "p", "q", "with_mean", "rank", sse=2, aic=4, aicc=4, bic=4)


def q_order_search_ar(spark, sf):
    best = arma.order_search(filtered(spark, sf), SERIES, "ts", "y", max_q=0, refine=False, blocking=HOURS)
    return show(best, "series", "p", "q", "with_mean", aicc=4)


def q_order_leaderboard_arma(spark, sf):
    board = arma.order_leaderboard(filtered(spark, sf), SERIES, "ts", "y", blocking=HOURS)
    return show(board, "series", "p", "q", "with_mean", "rank", sse=2, aic=4, aicc=4, bic=4)


def q_order_search(spark, sf):
    best = arma.order_search(filtered(spark, sf), SERIES, "ts", "y", blocking=HOURS)
    return show(best, "series", "p", "q", "with_mean", "n", "converged", sigma2=4, aicc=4)


def q_order_search_top(spark, sf):
    """The three best candidates refined."""
    best = arma.order_search(filtered(spark, sf), SERIES, "ts", "y", refine_top=3, blocking=HOURS)
    return show(best, "series", "p", "q", "with_mean", "n", "converged", sigma2=4, aicc=4)


def q_ar_fit_suppliers(spark, sf):
    """Many series at once: AR(2) with mean per supplier."""
    return coefficients(
        arma.arma_fit_hr(daily_suppliers(spark, sf), SERIES, "day", "price", 2, 0, True))


# ---- the same with many blocks per series -------------------------------------------------------

def q_lagged_blocks(spark, sf):
    rows = lagged(hourly(spark, sf), SERIES, "ts", "price", 3, SHORT)
    return show(rows, "series", "pos", text=("ts",), price=2, price_1=2, price_3=2)


def q_acf_blocks(spark, sf):
    return show(diagnostics.acf(hourly(spark, sf), SERIES, "ts", "price", blocking=SHORT), "series", "lag",
                rho=6, limit=6)


def q_arma_residuals_blocks(spark, sf):
    prices = hourly(spark, sf)
    models = model_table(prices, MODEL.phi, MODEL.theta)
    return show(arma.arma_residuals(prices, SERIES, "ts", "price", models, 3, SHORT),
                "series", text=("ts",), x=2, fitted=6, resid=6)


def q_arma_fit_hr_blocks(spark, sf):
    return coefficients(arma.arma_fit_hr(filtered(spark, sf), SERIES, "ts", "y", 3, 1, blocking=SHORT))


def q_order_leaderboard_blocks(spark, sf):
    board = arma.order_leaderboard(filtered(spark, sf), SERIES, "ts", "y", max_q=0, blocking=SHORT)
    return show(board, "series", "p", "q", "with_mean", "rank", sse=2, aic=4, aicc=4, bic=4)


def q_arma_fit_css_blocks(spark, sf):
    return css_columns(arma.arma_fit_css(filtered(spark, sf), SERIES, "ts", "y", 3, 1, blocking=SHORT))


def q_order_leaderboard_arma_blocks(spark, sf):
    board = arma.order_leaderboard(filtered(spark, sf), SERIES, "ts", "y", blocking=SHORT)
    return show(board, "series", "p", "q", "with_mean", "rank", sse=2, aic=4, aicc=4, bic=4)


# ---- spacings from milliseconds to weeks in one table: blocks have counted bounds ---------------------

def q_lagged_mixed(spark, sf):
    rows = lagged(mixed(spark, sf), SERIES, "ts", "price", 3, SHORT)
    return show(rows, "series", "pos", price=2, price_1=2, price_3=2)


def q_ljung_box_mixed(spark, sf):
    test = diagnostics.ljung_box(mixed(spark, sf), SERIES, "ts", "price", 10, 4)
    return show(test, "series", "n", "df", q=6, p_value=6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_series": scan_series,
    "series_select": q_series_select,
    "period_filter": q_period_filter,
    "harmonise_union": q_harmonise_union,
    "tidy_unpivot": q_tidy_unpivot,
    "dst_adjust": q_dst_adjust,
    "load_step_join": q_load_step_join,
    "weekly_hourly_align": q_weekly_hourly_align,
    "weekly_hourly_diff": q_weekly_hourly_diff,
    "prepared_dataset": q_prepared,
    "prepared_update": q_prepared_update,
    "load_step_calendar": q_load_step_calendar,
    "calendar_join": q_calendar_join,
    "prepared_calendar": q_prepared_calendar,
    "lagged": q_lagged,
    "cc_returns": q_cc_returns,
    "series_tail": q_series_tail,
    "train_holdout_split": q_train_holdout_split,
    "frac_diff": q_frac_diff,
    "sd_band": q_sd_band,
    "frac_diff_long": q_frac_diff_long,
    "sql_lagged": q_sql_lagged,
    "sql_acf": q_sql_acf,
    "sql_ljung_box": q_sql_ljung_box,
    "acf": q_acf,
    "ljung_box": q_ljung_box,
    "ljung_box_suppliers": q_ljung_box_suppliers,
    "fd_histogram": q_fd_histogram,
    "diff_distribution": q_diff_distribution,
    "diff_ecdf": q_diff_ecdf,
    "arma_residuals": q_arma_residuals,
    "accuracy_measures": q_accuracy,
    "residual_ljung_box": q_residual_ljung_box,
    "residual_acf": q_residual_acf,
    "residual_histogram": q_residual_histogram,
    "arma_evaluate": q_arma_evaluate,
    "coef_table": q_coef_table,
    "arma_forecast": q_arma_forecast,
    "forecast_vs_actual": q_forecast_vs_actual,
    "forecast_chart_frame": q_forecast_chart_frame,
    "arma_fit_hr": q_arma_fit_hr,
    "ar_fit_suppliers": q_ar_fit_suppliers,
    "arma_fit_css": q_arma_fit_css,
    "order_leaderboard": q_order_leaderboard,
    "order_search_ar": q_order_search_ar,
    "order_leaderboard_arma": q_order_leaderboard_arma,
    "order_search": q_order_search,
    "order_search_top": q_order_search_top,
    "lagged_blocks": q_lagged_blocks,
    "acf_blocks": q_acf_blocks,
    "arma_residuals_blocks": q_arma_residuals_blocks,
    "arma_fit_hr_blocks": q_arma_fit_hr_blocks,
    "order_leaderboard_blocks": q_order_leaderboard_blocks,
    "arma_fit_css_blocks": q_arma_fit_css_blocks,
    "order_leaderboard_arma_blocks": q_order_leaderboard_arma_blocks,
    "lagged_mixed": q_lagged_mixed,
    "ljung_box_mixed": q_ljung_box_mixed,
}
