"""Origins and windows: exact dates, refusals, and every later report in one window."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from tidemark.models import run

DAY = dt.date(2020, 1, 1)
ASKED = "retraining_days int, training_days int, target_lag int, first_origin date"


def archive(spark, lags=range(0, 40, 3), dates=range(0, 200, 7)):
    rows = [("a", DAY + dt.timedelta(r), DAY + dt.timedelta(r + n), n, float(10 + n)) for r in dates for n in lags]
    return spark.createDataFrame(rows, "geo_value string, reference_date date, report_date date, lag int, value double")


def calendar(spark, *asked):
    given = {"archive_a": archive(spark), "asked_backtest": spark.createDataFrame([asked], ASKED)}
    return run(spark, "retraining_calendar", given=given).orderBy("fold").collect()


def test_dates_of_origins(spark):
    got = calendar(spark, 50, 100, 28, None)
    assert [r["test_date"] for r in got] == [DAY + dt.timedelta(d) for d in (60, 110, 160, 210)]  # the last report is on day 235
    assert {r["testing_days"] for r in got} == {50} and {r["training_days"] for r in got} == {100}
    assert {r["experiment_end_date"] for r in got} == {DAY + dt.timedelta(260)}
    assert calendar(spark, None, None, 28, None)[0]["testing_days"] == 30  # of a daily archive
    assert [r["test_date"] for r in calendar(spark, 100, 100, 28, DAY + dt.timedelta(5))] == [DAY + dt.timedelta(d) for d in (5, 105, 205)]


@pytest.mark.parametrize(("asked", "why"), [((0, 10, 28, None), "at least one day"), ((10, 10, 28, DAY + dt.timedelta(236)), "after the last report"), ((10, 10, 28, DAY - dt.timedelta(1)), "before the first report")])
def test_refusals(spark, asked, why):
    with pytest.raises(PySparkException, match=why):
        calendar(spark, *asked)


@pytest.mark.parametrize("days", [30, 200])
def test_every_report_after_the_first_origin_is_in_one_window(spark, days):
    given = {"archive_a": archive(spark), "asked_backtest": spark.createDataFrame([(days, 100, 28, None)], ASKED)}
    cases = run(spark, "build_cases", given=given).select("reference_date", "report_date", "fold", "cutoff").collect()
    triangle = run(spark, "triangle", given=given).where("genuine_event AND target_date IS NOT NULL AND lag <= 28").collect()
    due = {(r["reference_date"], r["report_date"]) for r in triangle if r["report_date"] >= DAY + dt.timedelta(60)}
    assert len(cases) == len(due) and {(r["reference_date"], r["report_date"]) for r in cases} == due
    assert all(r["cutoff"] <= r["report_date"] < r["cutoff"] + dt.timedelta(days) for r in cases)


def test_settings_that_a_user_asks_for(spark):
    asked = spark.createDataFrame([(35, None, False, None, 21, None, None)], "target_lag int, lag_terms string, smoothed boolean, training_days int, retraining_days int, weekday_groups string, target_column string")
    given = {"archive_normalize": archive(spark)}
    own, more = (run(spark, "preparation_settings", given=g).first() for g in (given, given | {"user_settings": asked}))
    assert own["overrides"] == "" and own["retraining_days"] == 30 and own["weekday_groups"] == "mon,weekends" and own["smoothed"]
    assert more["overrides"] == "target_lag,smoothed,retraining_days" and (more["target_lag"], more["retraining_days"], more["target_column"], more["lag_terms"]) == (35, 21, "log_value_target", "1,7")
