"""Forecasts of other programs: what is refused, and what enters the long table."""

import pytest
from pyspark.sql import functions as F

from tidemark.models import run
from tidemark.operators import external, methods
from tidemark.operators.forecast import TAUS

SF = "/root/testdata/sf0.001"


def found(df, *args, **kwargs):
    return sorted((r["issue"], r["subject"], r["n"]) for r in external.check(df, *args, **kwargs).collect())


def test_issues(spark):
    kind = "geo_value string, reference_date string, report_date string, lag string, method string, prediction string"
    rows = [("a", "2020-01-01", "2020-01-02", "1", "m", "1"), ("a", "2020-01-01", "2020-01-02", "1", "m", "2"), ("b", "no date", "2020-01-02", "1", "m", "none"), ("c", "2020-01-01", None, "1", "k", "")]
    df = spark.createDataFrame(rows, kind)
    assert found(df, {"k": "k"}) == [("date cannot be read", "reference_date", 1), ("value is no number", "prediction", 1)]
    assert found(df, {"m": "m", "ours": "theirs"}) == [("date cannot be read", "reference_date", 1), ("method is missing", "ours", 1), ("rows share a key", "m", 2), ("value is no number", "prediction", 1)]
    assert ("no rows", "", 1) in found(df.where("false"), {"m": "m"})
    missing = found(df.drop("lag", "prediction"), {"k": "k"}, columns=("more",), quantiles="q{tau}")
    assert {s for i, s, _ in missing if i.startswith("column is missing")} == {"lag", "prediction", "more", *(f"q{float(t):g}" for t in TAUS)}


def test_methods_with_and_without_quantiles_are_scored(spark):
    before = dict(methods.METHODS)
    try:
        wide = run(spark, "register_method", SF)
        text = wide.select("geo_value", "reference_date", "report_date", "lag", F.lit("x").alias("who"), (F.col("prediction") + 1).cast("string").alias("value"), *(F.col(q).cast("string").alias(f"t{float(t):g}") for t, q in zip(TAUS, external.QS)))
        other = text.withColumn("who", F.lit("y")).where("lag % 3 = 0").withColumn("t0.5", F.lit(None).cast("string"))
        df = text.unionByName(other)
        with pytest.raises(ValueError, match="method is missing"):
            external.register(df, {"z": "z"}, "who", "value")
        external.register(df, {"ext": "x", "sparse": "y"}, "who", "value", "t{tau}")
        rows = {r["method"]: r for r in methods.evaluate(spark, "method_availability", SF, ("carry_forward", "ext", "sparse")).collect()}
        assert rows["ext"]["n"] == rows["sparse"]["n"] == rows["carry_forward"]["n"]
        assert rows["ext"]["probabilistic"] > 0 and rows["sparse"]["probabilistic"] == 0 and 0 < rows["sparse"]["available"] < rows["ext"]["available"]
    finally:
        methods.METHODS.clear()
        methods.METHODS.update(before)
