"""Readers and writers by files written here."""

import gzip

import pytest
from pyspark.errors import PySparkException

from tidemark.sources import files

HEAD = "reference_date,report_date,lag,value\n"


def test_a_file_for_each_location_by_preference_without_sidecars(spark, tmp_path):
    (tmp_path / "north.csv").write_text(HEAD + "2020-01-01,2020-01-01,0,-1\n")
    with gzip.open(tmp_path / "north.csv.gz", "wt") as f:
        f.write(HEAD + "2020-01-01,2020-01-03,2,5\n2020-01-02,x,,7.5\n")
    with gzip.open(tmp_path / "south.csv.gz", "wt") as f:
        f.write(HEAD + "2020-01-01,2020-01-02,1,n/a\n")
    with gzip.open(tmp_path / "schedule.csv.gz", "wt") as f:
        f.write("test_date\n2020-01-01\n")
    got = sorted(((r["geo_value"], r["lag"], r["value"], r["report_date"] is None) for r in files.read_triangles(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("north", 2, 5.0, False), ("north", None, 7.5, True), ("south", 1, None, False)], key=str)


def test_nothing_to_read_and_lags_with_fractions_are_refused(spark, tmp_path):
    (tmp_path / "summary.csv").write_text(HEAD)
    with pytest.raises(FileNotFoundError):
        files.read_triangles(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text(HEAD + "2020-01-01,2020-01-01,0.5,1\n")
    with pytest.raises(PySparkException, match="fractions"):
        files.read_triangles(spark, str(tmp_path)).collect()


def rows(df):
    return sorted((tuple(str(r[c]) for c in ("geo_value", "reference_date", "report_date", "lag", "value")) for r in df.collect()))


WANTED = [("north", "2020-01-01", "2020-01-03", "2", "5.0"), ("south", "2020-01-01", "2020-01-02", "1", "3.0"), ("west", "2020-01-01", "2020-01-04", "3", "None")]


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "north.csv").write_text("value,report_date,reference_date,lag\n5,2020-01-03,2020-01-01,2\n")
    (tmp_path / "south.csv").write_text(HEAD + "2020-01-01,2020-01-02,1,3\n")
    (tmp_path / "west.csv").write_text("lag,more,report_date,reference_date\n3,x,2020-01-04,2020-01-01\n")
    for name in ("schedule", "inventory", "test_dates"):
        (tmp_path / f"{name}.csv").write_text("fold,test_date\n" + "1,2020-01-01\n" * 500)
    assert rows(files.read_triangles(spark, str(tmp_path))) == WANTED
    assert len(files.read_archive(spark, str(tmp_path), {"geo_value": "fold"}).columns) > 5


def test_parquet_files_with_other_columns(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"value": [5.0], "report_date": ["2020-01-03"], "reference_date": ["2020-01-01"], "lag": [2]}), tmp_path / "north.parquet")
    pq.write_table(pa.table({"reference_date": ["2020-01-01"], "report_date": ["2020-01-02"], "lag": [1], "value": [3.0]}), tmp_path / "south.parquet")
    pq.write_table(pa.table({"more": ["x"], "reference_date": ["2020-01-01"], "report_date": ["2020-01-04"], "lag": [3]}), tmp_path / "west.parquet")
    pq.write_table(pa.table({"geo_value": ["north"], "rows": [7]}), tmp_path / "inventory.parquet")
    assert rows(files.read_triangles(spark, str(tmp_path))) == WANTED


def test_archives_under_other_names_and_without_a_location(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event,issue,amount\n2020-01-01,2020-01-02,3\n")
    names = {"reference_date": "event", "report_date": "issue", "value": "amount"}
    assert [(r["geo_value"], r["value"]) for r in files.read_archive(spark, str(tmp_path / "a.csv"), names).collect()] == [("all", 3.0)]
    with pytest.raises(ValueError):
        files.read_archive(spark, str(tmp_path / "a.csv"), {"value": "amount"})


def test_shares_of_a_denominator_and_lags(spark, tmp_path):
    (tmp_path / "a.csv").write_text("reference_date,report_date,value,all\n2020-01-01,2020-01-02,3,6\n2020-01-01,2020-01-03,3,0\n2020-01-01,2020-01-04,3,x\n2020-01-01,2021-01-04,3,6\n2020-01-03,2020-01-01,3,6\n")
    got = files.read_archive(spark, str(tmp_path / "a.csv"), denominator="all", lags=(0, 240)).orderBy("lag").collect()
    assert [(r["lag"], r["value"]) for r in got] == [(1, 0.5), (2, None), (3, None)]


def test_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 2.0), ("k", 2, 3.0)], "method string, fold int, x double")
    files.write_tables({"t": df, "u": df.select("x")}, str(tmp_path))
    back = files.read_tables(spark, str(tmp_path), ("t", "u"))
    assert sorted(map(tuple, back["t"].select("method", "fold", "x").collect())) == [("k", 2, 3.0), ("m", 1, 2.0)] and back["u"].count() == 2
