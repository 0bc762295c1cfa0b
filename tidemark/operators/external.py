"""Forecasts that other programs made: a table in a form of their own is checked, and its methods enter the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import rounded, run
from . import methods
from .forecast import KEY, QS, TAUS

#: Columns that a row must have to tell its case; dates among those that it may have.
LEAST = ("geo_value", "reference_date", "report_date", "lag")
DATES = ("cutoff", "reference_date", "report_date", "target_date")


def _col(name: str):
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


_ISSUE = "issue string, subject string, n long"


def check(df: DataFrame, names: dict[str, str], method: str = "method", prediction: str = "prediction", columns: tuple[str, ...] = (), quantiles: str | None = None) -> DataFrame:
    """What stands against using df: issue, subject, n; no rows if nothing does.

    names: methods for their names in df. quantiles: a pattern with {tau} for the columns of the nine levels. Columns are
    looked up in the schema; all that must be counted is counted in one pass, and repeated keys in a second.
    """
    spark, have = df.sparkSession, set(df.columns)
    known = [(f"column is missing: {c}", c, None) for c in (*LEAST, method, prediction, *columns, *(_levels(quantiles) if quantiles else ())) if c not in have]
    found = [spark.createDataFrame(known, _ISSUE)]
    filled = lambda c: _col(c).isNotNull() & (F.trim(_col(c).cast("string")) != "")
    wrong = {}
    if prediction in have:
        wrong[("value is no number", prediction)] = filled(prediction) & _col(prediction).cast("string").try_cast("double").isNull()
    for c in (_levels(quantiles) if quantiles else ()):
        if c in have:
            wrong[("value is no number", c)] = filled(c) & _col(c).cast("string").try_cast("double").isNull()
    for c in DATES:
        if c in have:
            wrong[("date cannot be read", c)] = filled(c) & F.col(c).cast("string").try_cast("date").isNull()
    if method in have:
        for own, theirs in names.items():
            wrong[("method is missing", own)] = _col(method) == theirs
    counted = df.agg(F.count(F.lit(1)).alias("_all"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(wrong.values())))
    rows = [F.struct(F.lit("no rows").alias("issue"), F.lit("").alias("subject"), F.when(F.col("_all") == 0, 1).otherwise(0).cast("long").alias("n"))]
    for i, (issue, subject) in enumerate(wrong):
        n = F.when(F.col(f"_{i}") == 0, 1).otherwise(0).cast("long") if issue == "method is missing" else F.col(f"_{i}")
        rows.append(F.struct(F.lit(issue).alias("issue"), F.lit(subject).alias("subject"), n.alias("n")))
    found.append(counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0"))
    keys = [c for c in KEY if c in have]
    if keys and method in have:
        own = df.where(_col(method).isin(list(names.values())))
        twice = own.groupBy(_col(method), *keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(twice.groupBy(method).agg(F.sum("n").alias("n")).select(F.lit("rows share a key").alias("issue"), _col(method).cast("string").alias("subject"), "n"))
    return reduce(DataFrame.unionByName, found)


def _levels(pattern: str) -> list[str]:
    return [pattern.format(tau=f"{float(t):g}") for t in TAUS]


def forecasts(df: DataFrame, name: str, cases: DataFrame, method: str = "method", prediction: str = "prediction", quantiles: str | None = None) -> DataFrame:
    """The forecasts of one of df's methods for the cases they are of, by the columns of the key that df has."""
    keys = [c for c in KEY if c in df.columns]
    kinds = dict(cases.dtypes)
    number = lambda c: _col(c).cast("string").try_cast("double")
    values = [number(prediction).alias("prediction"), *(number(c).alias(q) for c, q in zip(_levels(quantiles), QS))] if quantiles else [number(prediction).alias("prediction")]
    own = df.where(_col(method) == name).select(*(F.col(k).cast("string").try_cast(kinds[k]).alias(k) for k in keys), *values)
    return cases.select(*KEY).join(own, keys)


def register(df: DataFrame, names: dict[str, str], method: str = "method", prediction: str = "prediction", quantiles: str | None = None) -> None:
    """Each of names becomes a method whose forecasts are df's; each keeps its own availability. What check finds is an error."""
    if issues := check(df, names, method, prediction, quantiles=quantiles).collect():
        raise ValueError("; ".join(f"{r['issue']} ({r['subject']}{f', {r["n"]}' if r['n'] else ''})" for r in issues))
    for own, theirs in names.items():
        methods.register(own, lambda spark, sf_dir, given, theirs=theirs: forecasts(df, theirs, run(spark, "build_cases", sf_dir, given), method, prediction, quantiles))


def external_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's own forecasts handed out as text with names of another program, read back, and scored beside it: n, available, probabilistic, mean error."""
    wide = run(spark, "register_method", sf_dir)
    given = wide.selectExpr("geo_value", "CAST(reference_date AS STRING) AS reference_date", "CAST(report_date AS STRING) AS report_date", "CAST(lag AS STRING) AS lag", "'THEIRS' AS program",
                            "CAST(prediction AS STRING) AS point", *(f"CAST({q} AS STRING) AS `p{float(t):g}`" for t, q in zip(TAUS, QS)))
    flat = given.selectExpr("*").withColumn("program", F.lit("POINTS")).where("lag % 2 = 0")
    both = given.unionByName(flat.withColumns({f"p{float(t):g}": F.lit(None).cast("string") for t in TAUS}))
    cases = run(spark, "build_cases", sf_dir)
    parts = [forecasts(both, name, cases, "program", "point", "p{tau}").withColumn("method", F.lit(name)) for name in ("THEIRS", "POINTS")]
    rows = reduce(DataFrame.unionByName, parts).join(cases.select("fold", "geo_value", "reference_date", "report_date", "truth"), ["fold", "geo_value", "reference_date", "report_date"])
    return rounded(rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("available"), F.count("q0_01").alias("probabilistic"), F.avg(F.abs(F.col("truth") - F.col("prediction"))).alias("mean_ae")), 6)


QUERIES = {"external_methods": external_methods}
