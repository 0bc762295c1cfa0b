"""Models on literal archives, and registered queries against DuckDB on the smallest tables."""

import datetime as dt
import os
from pathlib import Path

import pytest

import tidemark.registry  # noqa: F401
from tidemark.functions import dialect
from tidemark.models import MODELS, in_sql, oracle, run

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 1)


def archive(spark, rows):
    """rows: (geo, reference day, lag, value)"""
    data = [(g, DAY + dt.timedelta(r), DAY + dt.timedelta(r + lag), lag, float(v)) for g, r, lag, v in rows]
    return spark.createDataFrame(data, "geo_value string, reference_date date, report_date date, lag int, value double")


def test_the_ninety_percent_rule_takes_the_first_lag_that_passes(spark):
    rows = []
    for e in range(10):
        rows += [("a", e, 0, 40), ("a", e, 7, 90 if e < 6 else 50), ("a", e, 14, 90), ("a", e, 21, 100)]
    rows.append(("a", 60, 0, 0))  # only moves the last report; a final value of zero does not count
    got = {r["candidate"]: r for r in run(spark, "completion_curve", given={"archive_normalize": archive(spark, rows)}).collect()}
    assert got[7]["median_error"] == pytest.approx(0.1) and got[7]["rate"] == pytest.approx(0.6)
    assert got[7]["q10"] == pytest.approx(0.1) and got[7]["q90"] == pytest.approx(0.5)
    assert [c for c, r in got.items() if r["recommended"]] == [14]


def test_the_first_release_is_never_genuine(spark):
    rows = [("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 0, 2, 2)]
    got = run(spark, "genuine_events", given={"archive_normalize": archive(spark, rows)}).orderBy("lag").collect()
    assert [r["genuine"] for r in got] == [False, False, True]


def test_normalizing_keeps_the_last_row_and_drops_what_cannot_be_read(spark):
    rows = [("a", "2020-01-01", "2020-01-02", "1", 1), ("a", "2020-01-01", "2020-01-02", "2", 2), ("a", "2020-01-03", "2020-01-02", "3", 3), ("a", "x", "2020-01-02", "3", 4), ("a", "2020-01-01", "2020-01-03", None, 5)]
    raw = spark.createDataFrame(rows, "place string, event string, issue string, amount string, seq long")
    got = run(spark, "archive_normalize", given={"raw_file": raw}).collect()
    assert [(r["lag"], r["value"]) for r in got] == [(1, 2.0)]


def test_monotone_curves_pass_their_knots_and_stay_between_them(spark):
    given = {"archive_a": archive(spark, [("a", 0, 0, 10), ("a", 0, 5, 20), ("a", 0, 20, 40), ("a", 60, 0, 1)])}
    got = {r["lag"]: r["remaining"] for r in run(spark, "episode_curves", given=given).collect() if r["reference_date"] == DAY}
    import math

    assert got[28] == pytest.approx(0) and got[0] == pytest.approx(math.log(41) - math.log(11)) and got[5] == pytest.approx(math.log(41) - math.log(21))
    values = [got[i] for i in range(29)]
    assert all(a >= b - 1e-12 for a, b in zip(values, values[1:]))


def test_training_never_sees_reports_from_the_origin_on(spark):
    rows = run(spark, "completed_training", SF)
    assert rows.where("report_date >= cutoff OR target_date > cutoff").isEmpty()


def test_flat_line_counts(spark):
    data = [("m", "b", 1, a, b) for a, b in zip((0.5, 2.0, 5.0, 1.0), (1.0, 2.0, 3.0, 4.0))]
    paired = spark.createDataFrame(data, "method string, baseline string, lag int, absolute_error double, base_error double")
    got = run(spark, "flat_line_comparison", given={"paired": paired}).first()
    assert (got["better"], got["worse"], got["tied"], got["saved"]) == (2, 1, 1, 1.5)


def test_order_statistics_differ_as_they_should(spark):
    rows = spark.createDataFrame([(1, "m", "a", 0, float(x)) for x in range(1, 11)], "fold int, method string, geo_value string, lag int, absolute_error_working double")
    given = {"history_strata_rows": rows}
    assert run(spark, "upper_order_statistic", given=given).first()["q_error"] == 10
    assert run(spark, "quantile_higher", given=given).first()["q_higher"] == 10


ASKED = "cadence_days int, cutoff date, follow_up int, first_lag int, wanted double"


def test_the_search_for_a_lag_goes_as_far_as_the_archive_and_says_why_it_fails(spark):
    rows = [("a", e, n, v) for e in range(0, 200, 10) for n, v in ((0, 50), (10, 95), (70, 100))] + [("b", 0, 40, 1.0), ("b", 0, 70, 1.0)]
    given = {"archive_normalize": archive(spark, rows)}
    search = lambda *asked: run(spark, "target_lag_asof", given=given | {"lag_search": spark.createDataFrame([asked], ASKED)}).collect()
    got = {r["candidate"]: r for r in search(10, None, None, None, 0.9)}
    assert sorted(got) == [10, 20, 30, 40, 50, 60, 70] and {r["selected"] for r in got.values()} == {10} and got[10]["rate"] == 1 and got[10]["status"] == "selected"
    assert (got[30]["episodes"], got[40]["episodes"]) == (20, 21)  # one is first reported at lag 40
    assert {r["episodes"] for r in search(10, None, None, 5, 0.9) if r["candidate"] >= 40} == {20}  # unless it must be reported by lag 5
    assert {r["candidate"]: r["episodes"] for r in search(35, None, 30, None, 0.9)} == {35: 20, 70: 0}
    assert {r["status"] for r in search(10, None, None, None, 1.1)} == {"no lag reaches the rate"}
    assert [r["status"] for r in search(100, None, None, None, 0.9)] == ["no report is late enough for a candidate"]
    assert [r["status"] for r in search(7, DAY - dt.timedelta(1), None, None, 0.9)] == ["no reports"]
    early = search(10, DAY + dt.timedelta(12), None, None, 0.9)
    assert {r["candidate"] for r in early} == {10} and early[0]["episodes"] == 1


def test_columns_of_any_triangle(spark):
    df = spark.createDataFrame([("a", DAY, DAY, 0, 1.0, None, 1, "x"), ("a", DAY, DAY, 1, None, None, 0, "y")], "geo_value string, reference_date date, report_date date, lag int, log_delta_value_7dav_lag14 double, other double, Sat_ref int, note_issue string")
    got = {r["column_name"]: (r["missing"], r["fraction"]) for r in run(spark, "missingness", given={"triangle": df}).collect()}
    assert got["log_delta_value_7dav_lag14"] == (1, 0.5) and got["other"] == (2, 1.0) and got["note_issue"] == (0, 0.0) and len(got) == 8
    assert {r["fraction"] for r in run(spark, "missingness", given={"triangle": df.where("false")}).collect()} == {None}
    assert run(spark, "issued_context_columns", given={"triangle": df}).columns == ["geo_value", "reference_date", "report_date", "lag", "log_delta_value_7dav_lag14", "Sat_ref"]


def test_macros_nest():
    assert dialect.write("{days({plus(a; 1)}; b)}", dialect.SPARK) == "datediff(date_add(a, CAST(1 AS INT)), b)"


def test_every_model_can_be_reached_and_every_input_exists():
    from tidemark.models import TABLES
    from tidemark.registry import QUERIES, SQL

    assert set(SQL) <= set(QUERIES)
    for m in MODELS.values():
        assert all(i in MODELS or i in TABLES for i in m.inputs()), m.name
        assert oracle(m.name) or not in_sql(m.name)


@pytest.mark.parametrize("name", ["archive_normalize", "completion_curve", "archive_report", "build_cases", "process_shift", "history_strata", "interval_calibration", "cluster_bootstrap", "accuracy_overall", "nearest_threshold", "donor_forecast"])
def test_query_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.registry import QUERIES, SQL

    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple(str(round(x, 4) + 0.0) if isinstance(x, float) else str(x) for x in row)
    mine = sorted(key(r) for r in df.select(*columns).collect())
    theirs = sorted(key(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


_GROWING = ("alignment_rows", "opposed_objectives", "qerr_discrimination", "alert_confusion", "external_predictions", "weighted_resample", "dual_alert_contrasts", "nearest_threshold", "small_pool_fallback", "quantile_fit", "routing_audit_by_lag")


@pytest.mark.parametrize("name", _GROWING)
def test_only_written_models_read_the_tables(name):
    """Whatever a query reads of the driver's tables comes from models that are written, so that each table is read once."""
    from tidemark.models import STORED, TABLES

    todo, seen = [name], set()
    while todo:
        m = MODELS[todo.pop()]
        assert m.name in STORED or not TABLES & set(m.inputs()), m.name
        todo += [i for i in m.inputs() if i in MODELS and i not in seen]
        seen |= set(m.inputs())


def test_lines_of_orders_are_read_by_one_written_step(spark, monkeypatch):
    from tidemark import models

    read = []

    def noting(df, name):
        read.append((name, any("lineitem" in f for f in df.inputFiles())))
        return written(df, name)

    written = models.stored
    monkeypatch.setattr(models, "stored", noting)
    monkeypatch.setattr(models, "_kept", {})
    last = run(spark, "process_shift", SF)
    assert [name for name, of_lines in read if of_lines] == ["archive_a"]
    assert not any("lineitem" in f for f in last.inputFiles())


def test_refusals(spark):
    from tidemark.functions.schema import derive_transform, map_columns, normalize_lag_types

    df = spark.createDataFrame([("a", 1.0, 2.5)], "place string, lag double, target_lag double")
    assert map_columns(df, {"geo_value": "place"}, ("geo_value",)).columns[0] == "geo_value"
    for names in ({}, {"geo_value": "nowhere"}, {"lag": "place", "geo_value": "place"}):
        with pytest.raises(ValueError):
            map_columns(df, names, ("geo_value",))
    with pytest.raises(ValueError):
        normalize_lag_types(df)
    assert dict(normalize_lag_types(df.drop("target_lag")).dtypes)["lag"] == "int"
    with pytest.raises(ValueError):
        derive_transform(spark.createDataFrame([(-1.0,)], "log_value_7dav double"))
