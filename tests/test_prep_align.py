from datetime import date, datetime

import pytest

from seriesmill.operators.align import (
    calendar_join, load_step_calendar, load_step_join, operating_week, weekly_hourly_align, weekly_hourly_diff,
)
from seriesmill.operators.prep import (
    dst_adjust, harmonise_union, period_filter, series_select, tidy_unpivot,
)
from seriesmill.plans.lifecycle import prepare
from seriesmill.sources.tables import read_prepared, read_series, write_prepared


def hours(spark, rows):
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, price double")


def test_operating_week_starts_on_saturday(spark):
    days = spark.createDataFrame(
        [(date(2020, 11, 5),), (date(2020, 11, 6),), (date(2020, 11, 7),), (date(2020, 11, 8),)],
        "d date")
    got = [r[0] for r in days.select(operating_week(days.d)).collect()]
    assert got == [date(2020, 10, 31), date(2020, 10, 31), date(2020, 11, 7), date(2020, 11, 7)]


def test_weekly_price_holds_from_the_saturday_after_publication(spark):
    hourly = hours(spark, [
        ("a", datetime(2020, 11, 6, 23), 1.0), ("a", datetime(2020, 11, 7, 0), 2.0),
        ("a", datetime(2020, 11, 12, 5), 3.0), ("a", datetime(2020, 11, 14, 0), 4.0)])
    weekly = spark.createDataFrame(
        [("a", date(2020, 11, 6), 100.0), ("a", date(2020, 11, 4), 90.0)],
        "series string, pub_date date, price double")
    paired = weekly_hourly_align(hourly, weekly, ["series"], "ts", step_column=None)
    got = {r.hourly: (r.op_week, r.weekly) for r in paired.collect()}
    assert got == {
        1.0: (date(2020, 10, 31), None), 2.0: (date(2020, 11, 7), 100.0),
        3.0: (date(2020, 11, 7), 100.0), 4.0: (date(2020, 11, 14), None)}
    diffs = {r.hourly: (r.diff, r.issue_date) for r in weekly_hourly_diff(paired, "ts").collect()}
    assert diffs == {2.0: (-98.0, date(2020, 11, 6)), 3.0: (-97.0, date(2020, 11, 11))}


def test_load_steps_by_day_type(spark):
    hourly = hours(spark, [
        ("a", datetime(2024, 1, 1, 5), 1.0), ("a", datetime(2024, 1, 2, 5), 2.0),
        ("a", datetime(2024, 1, 6, 5), 3.0), ("a", datetime(2024, 1, 6, 6), 4.0)])
    holidays = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 1),)], "d date")
    steps = spark.createDataFrame(
        [("holiday", 5, "light"), ("weekday", 5, "heavy"), ("weekend", 5, "medium"),
         ("weekend", 5, "medium")], "day_type string, hour int, load_step string")
    got = {r.price: (r.day_type, r.load_step)
           for r in load_step_join(hourly, "ts", holidays, steps).collect()}
    assert got == {1.0: ("holiday", "light"), 2.0: ("weekday", "heavy"),
                   3.0: ("weekend", "medium"), 4.0: ("weekend", None)}
    clash = steps.unionByName(steps.limit(1).replace("light", "heavy"))
    with pytest.raises(Exception, match="two load steps"):
        load_step_join(hourly, "ts", holidays, clash).collect()


def test_dst_edges_move_by_thirty_minutes(spark):
    hourly = hours(spark, [("a", datetime(2018, 11, 4, h), float(h)) for h in range(3)]
                   + [("a", datetime(2019, 2, 16, 23), 9.0)])
    edges = spark.createDataFrame(
        [(datetime(2018, 11, 4, 0), "start"), (datetime(2019, 2, 16, 23), "end")],
        "edge_ts timestamp_ntz, kind string")
    got = {r.price: r.ts for r in dst_adjust(hourly, "ts", edges).collect()}
    assert got == {0.0: datetime(2018, 11, 4, 0, 30), 1.0: datetime(2018, 11, 4, 1),
                   2.0: datetime(2018, 11, 4, 2), 9.0: datetime(2019, 2, 16, 23, 30)}


def test_period_includes_both_days_and_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    hours(spark, [("a", datetime(2018, 4, 16, 23), 1.0), ("a", datetime(2018, 4, 17, 0), 2.0),
                  ("a", datetime(2020, 11, 6, 23), 3.0), ("a", datetime(2020, 11, 7, 0), 4.0)]
          ).write.parquet(path)
    kept = period_filter(read_series(spark, path), "ts", date(2018, 4, 17), date(2020, 11, 6))
    assert sorted(r.price for r in kept.collect()) == [2.0, 3.0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_select_keeps_one_step_and_checks_columns(spark):
    df = spark.createDataFrame([("a", 1, 5, "light"), ("a", 2, 6, "heavy")],
                               "series string, t int, v int, load_step string")
    got = series_select(df, ["series"], "t", "v", "light").collect()
    assert [(r.t, r.x) for r in got] == [(1, 5.0)]
    with pytest.raises(ValueError, match="missing"):
        series_select(df, ["series"], "t", "nothing")


def test_union_by_name_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "light")], "hora int, patamar string")
    b = spark.createDataFrame([("light", 1), ("heavy", 2)], "load_step string, hour int")
    got = harmonise_union([a, a, b], [{"hora": "hour", "patamar": "load_step"}] * 2 + [{}])
    assert sorted(map(tuple, got.collect())) == [
        (1, "light"), (1, "light"), (1, "light"), (2, "heavy")]


def test_unpivot(spark):
    wide = spark.createDataFrame([("w", 1.0, None)], "d string, north double, south double")
    got = sorted(tidy_unpivot(wide, ["d"], ["north", "south"]).collect())
    assert [tuple(r) for r in got] == [("w", "north", 1.0), ("w", "south", None)]


def test_write_and_read_prepared(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", date(2020, 10, 31), 1.0), ("a", date(2020, 11, 7), 2.0)],
                               "series string, op_week date, price double")
    write_prepared(df, path)
    back = read_prepared(spark, path)
    assert sorted(r.price for r in back.collect()) == [1.0, 2.0]
    one = back.where("op_week = date'2020-11-07'")
    assert [r.price for r in one.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(op_week" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        write_prepared(df, path)


def test_csv_needs_a_schema_and_fails_on_bad_values(spark, tmp_path):
    path = tmp_path / "y.csv"
    path.write_text("hour,price\n1,2.5\n2,oops\n")
    with pytest.raises(ValueError, match="schema"):
        read_series(spark, str(path), fmt="csv")
    with pytest.raises(Exception):
        read_series(spark, str(path), "hour int, price double", "csv").collect()


@pytest.mark.parametrize("row", [("weekday", 24, "light"), ("Sunday", 3, "light"), (None, 3, "light")])
def test_unknown_load_steps_stop_the_job(spark, row):
    steps = spark.createDataFrame([("weekday", 1, "light"), row], "day_type string, hour int, load_step string")
    hourly = hours(spark, [("a", datetime(2024, 1, 1, 1), 1.0)])
    holidays = spark.createDataFrame([], "d date")
    with pytest.raises(Exception, match="unknown day type or hour"):
        load_step_join(hourly, "ts", holidays, steps).collect()


def test_publications_without_a_price_and_ties(spark):
    hourly = hours(spark, [("a", datetime(2020, 11, 7, 0), 1.0)])
    weekly = spark.createDataFrame(
        [("a", date(2020, 11, 4), 90.0), ("a", date(2020, 11, 6), None)], "series string, pub_date date, price double")
    got = weekly_hourly_align(hourly, weekly, ["series"], "ts", step_column=None).collect()
    assert [r.weekly for r in got] == [90.0]
    tied = weekly.unionByName(weekly.replace(90.0, 91.0))
    with pytest.raises(Exception, match="two weekly prices"):
        weekly_hourly_align(hourly, tied, ["series"], "ts", step_column=None).collect()


# ---- load-step calendars with times --------------------------------------------------------------

def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M")


def stamped(spark):
    """Two yearly tables with columns of their own that class one hour of the day differently."""
    first = spark.createDataFrame(
        [(at("2018-12-31 00:00"), "light"), (at("2018-12-31 07:00"), "medium"), (at("2018-12-31 18:00"), "heavy"),
         (at("2018-12-31 18:00"), "heavy"), (None, "light")], "instante timestamp_ntz, patamar string")
    second = spark.createDataFrame(
        [("2019-01-01 00:00:00", "light"), ("2019-01-01 07:00:00", "light"), ("2019-01-01 18:00:00", "medium")],
        "hora string, step string")
    edges = spark.createDataFrame([(at("2018-12-31 07:00"), "start")], "edge_ts timestamp_ntz, kind string")
    return [first, second], [{"instante": "ts", "patamar": "load_step"}, {"hora": "ts", "step": "load_step"}], edges


def test_calendar_of_yearly_tables(spark):
    found = {r["ts"]: r["load_step"] for r in load_step_calendar(*stamped(spark)).collect()}
    assert found == {
        at("2018-12-31 00:00"): "light", at("2018-12-31 07:30"): "medium", at("2018-12-31 18:00"): "heavy",
        at("2019-01-01 00:00"): "light", at("2019-01-01 07:00"): "light", at("2019-01-01 18:00"): "medium"}


def test_a_time_with_two_steps_stops_the_job(spark):
    tables, renames, edges = stamped(spark)
    again = spark.createDataFrame([("2018-12-31 18:00:00", "light")], "hora string, step string")
    with pytest.raises(Exception, match="two load steps"):
        load_step_calendar([*tables, again], [*renames, renames[1]], edges).collect()


def test_hours_take_the_step_in_force(spark):
    calendar = load_step_calendar(*stamped(spark))
    times = {
        "2018-12-30 23:00": None, "2018-12-30 23:30": "light", "2018-12-31 06:00": "light",
        "2018-12-31 07:00": "medium",  # its own row, moved to half past
        "2018-12-31 17:00": "medium", "2018-12-31 23:00": "heavy", "2019-01-01 07:00": "light",
        "2019-01-01 18:00": "medium", "2019-01-02 17:00": "medium", "2019-01-02 18:00": None, "2019-01-05 00:00": None}
    hourly = spark.createDataFrame([(k, at(k), i) for i, k in enumerate(times)] + [("none", None, 1)],
                                   "name string, t timestamp_ntz, _more int")
    found = calendar_join(hourly, "t", calendar)
    assert found.columns == ["name", "t", "_more", "load_step"]
    assert {r["name"]: r["load_step"] for r in found.collect()} == {**times, "none": None}
    assert calendar_join(hourly, "t", calendar.limit(0)).where("load_step IS NOT NULL").isEmpty()


def test_calendars_by_market(spark):
    calendar = spark.createDataFrame(
        [("n", at("2019-01-01 00:00"), "light"), ("s", at("2019-01-01 00:00"), "heavy")],
        "market string, ts timestamp_ntz, load_step string")
    hourly = spark.createDataFrame([(m, at("2019-01-01 05:00")) for m in "nsx"], "market string, t timestamp_ntz")
    found = calendar_join(hourly, "t", calendar, ["market"])
    assert {r["market"]: r["load_step"] for r in found.collect()} == {"n": "light", "s": "heavy", "x": None}


def test_tables_with_and_without_times_do_not_mix(spark):
    tables, renames, edges = stamped(spark)
    plain = spark.createDataFrame([("weekday", 1, "light")], "day_type string, hour int, load_step string")
    hourly = spark.createDataFrame([("a", at("2019-01-01 05:00"), 1.0)], "series string, ts timestamp_ntz, price double")
    with pytest.raises(ValueError, match="time column"):
        prepare(hourly, hourly, [tables[0], plain], [renames[0], {}], None, edges, ["series"])
