from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalift.operators import (
    forecast_vs_actual,
    forecast_window,
    label_split,
    slice_inclusive,
    time_split,
)

SERIES = "day DATE, wind DOUBLE, power DOUBLE"


def series(spark, days):
    return spark.createDataFrame([(d, float(i), i * 10.0) for i, d in enumerate(days)], SERIES)


def days_from(first, n, step=1):
    return [first + timedelta(days=i * step) for i in range(n)]


def found(df):
    return [(r.day, r.has_actual) for r in df.orderBy("day").collect()]


def test_both_ends_are_included(spark):
    df = series(spark, days_from(date(2017, 12, 30), 6))
    inside = slice_inclusive(df, "day", "2017-12-31", date(2018, 1, 2))
    assert [r.day.day for r in inside.orderBy("day").collect()] == [31, 1, 2]


@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz"])
def test_samples_later_on_the_last_day_are_outside(spark, kind):
    times = ["2017-12-31 16:00:00", "2018-01-01 00:00:00", "2018-01-01 08:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "at STRING").withColumn("at", F.col("at").cast(kind))
    high = "2018-01-01 00:00:00" if kind == "string" else "2018-01-01"
    assert slice_inclusive(df, "at", "2017-12-31", high).count() == 2


def test_boundary_day_is_in_both_spans(spark, rows):
    df = series(spark, [date(2013, 12, 31), date(2014, 1, 1), date(2018, 1, 1), date(2019, 1, 1), date(2019, 1, 2)])
    split = time_split(
        df, "day", {"train": ("2014-01-01", "2018-01-01"), "validation": ("2018-01-01", "2019-01-01")}
    )
    assert rows(split.select("split", "day")) == [
        ("train", date(2014, 1, 1)),
        ("train", date(2018, 1, 1)),
        ("validation", date(2018, 1, 1)),
        ("validation", date(2019, 1, 1)),
    ]
    assert split.columns == ["split", "day", "wind", "power"]


def test_split_is_one_filtered_scan(spark, tmp_path):
    series(spark, days_from(date(2014, 1, 1), 5)).write.parquet(f"{tmp_path}/s")
    split = time_split(
        spark.read.parquet(f"{tmp_path}/s"), "day", {"a": ("2014-01-01", "2014-01-02"), "b": ("2014-01-04", "2014-01-05")}
    )
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "PushedFilters: [Or(" in plan


def test_label_split(spark):
    features, label = label_split(series(spark, days_from(date(2014, 1, 1), 2)), "power", ["day"])
    assert features.columns == ["day", "wind"]
    assert label.columns == ["day", "power"]


def test_window_around_the_anchor(spark):
    anchor = date(2018, 6, 15)
    df = series(spark, days_from(date(2018, 6, 1), 30))
    expected = [(d, d <= anchor) for d in days_from(date(2018, 6, 10), 11)]
    for given in (anchor, "2018-06-15", F.lit("2018-06-15").cast("date")):
        assert found(forecast_window(df, "day", given)) == expected


def test_window_with_just_enough_rows(spark):
    df = series(spark, days_from(date(2018, 6, 11), 10))
    assert len(found(forecast_window(df, "day", "2018-06-15"))) == 10


def test_tail_stands_in_for_a_short_window(spark):
    days = days_from(date(2018, 1, 1), 5) + days_from(date(2018, 6, 11), 9)
    expected = [(d, i < 5) for i, d in enumerate(days[-10:])]
    assert found(forecast_window(series(spark, days), "day", "2018-06-15")) == expected


def test_missing_days_make_the_window_short(spark):
    days = days_from(date(2018, 1, 1), 40, step=5)
    assert found(forecast_window(series(spark, days), "day", "2018-03-01")) == [
        (d, i < 5) for i, d in enumerate(days[-10:])
    ]


@pytest.mark.parametrize("n", [0, 3, 5, 7])
def test_fewer_rows_than_the_tail(spark, n):
    days = days_from(date(2018, 1, 1), n)
    got = found(forecast_window(series(spark, days), "day", "2020-01-01"))
    # all but the last five have an actual
    assert got == [(d, i < n - 5) for i, d in enumerate(days)]


def test_anchor_defaults_to_today(spark):
    today = spark.range(1).select(F.current_date()).first()[0]
    df = series(spark, days_from(today - timedelta(days=8), 16))
    got = found(forecast_window(df, "day"))
    assert [d for d, _ in got] == days_from(today - timedelta(days=5), 11)
    assert sum(actual for _, actual in got) == 6


def test_timestamps_in_the_window(spark):
    start = datetime(2018, 6, 1)
    df = spark.createDataFrame([(start + timedelta(hours=8 * i),) for i in range(90)], "day TIMESTAMP_NTZ")
    got = found(forecast_window(df, "day", "2018-06-15"))
    assert got[0] == (datetime(2018, 6, 10), True)
    assert got[-1] == (datetime(2018, 6, 20), False)
    assert len(got) == 31
    assert max(d for d, actual in got if actual) == datetime(2018, 6, 15)


def test_tail_is_a_top_k(spark, tmp_path):
    series(spark, days_from(date(2018, 1, 1), 20)).write.parquet(f"{tmp_path}/s")
    df = forecast_window(spark.read.parquet(f"{tmp_path}/s"), "day", "2018-01-10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "GreaterThanOrEqual(day,2018-01-05)" in plan


def test_predictions_keep_days_without_actual(spark, rows):
    predictions = spark.createDataFrame([(1, 1.5), (2, 2.5)], "day INT, prediction DOUBLE")
    actuals = spark.createDataFrame([(0, 9.0), (1, 1.0)], "day INT, power DOUBLE")
    assert rows(forecast_vs_actual(predictions, actuals, "day")) == [(1, 1.5, 1.0), (2, 2.5, None)]
