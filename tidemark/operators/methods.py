"""Forecast methods by name: any callable that returns a DataFrame of forecasts enters the long table and what reads it.

A method is a name and either a model of this library or a callable (spark, sf_dir, given) -> DataFrame with the case's
key, prediction and the nine quantiles on the working scale; quantiles may be missing or null. Cases without a
forecast stay, as not available.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..models import rounded, run
from .forecast import KEY, QS, TAUS, wis

Method = Callable[[SparkSession, str | None, dict[str, DataFrame] | None], DataFrame]
METHODS: dict[str, Method] = {}


def register(name: str, forecasts: Method | str | None = None, **where: str):
    """Register forecasts under name: a callable, or a model's name with values its rows must have. Also a decorator."""

    def add(f: Method | str) -> Method | str:
        if name in METHODS:
            raise ValueError(f"there is a method {name} already")

        def of_model(spark: SparkSession, sf_dir: str | None, given: dict[str, DataFrame] | None) -> DataFrame:
            df = run(spark, f, sf_dir, given)
            return reduce(lambda d, c: d.where(F.col(c) == where[c]), where, df)

        METHODS[name] = of_model if isinstance(f, str) else f
        return f

    return add if forecasts is None else add(forecasts)


def long_table(spark: SparkSession, sf_dir: str | None = None, names: tuple[str, ...] | None = None, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """standardize_predictions of the named methods (all without names), a row for each case and method.

    Two forecasts of one method for a case are an error, wherever they come from.
    """
    cases = run(spark, "build_cases", sf_dir, given)
    key = ["fold", "geo_value", "reference_date", "report_date"]
    parts = []
    for name in names or METHODS:
        df = METHODS[name](spark, sf_dir, given)
        have = set(df.columns)
        own = df.select(*key, F.col("prediction").cast("double").alias("prediction"), *((F.col(q) if q in have else F.lit(None)).cast("double").alias(q) for q in QS))
        twice = F.raise_error(F.concat(F.lit(f"{name}: two forecasts of "), F.concat_ws(" ", *key)))
        own = own.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("prediction", *QS)).alias("_f"))
        own = own.select(*key, F.when(F.col("_n") > 1, twice).otherwise(F.col("_f")).alias("_f")).select(*key, "_f.*")
        # a distribution is there whole or not at all
        whole = reduce(lambda a, b: a & b, (F.col(q).isNotNull() & ~F.isnan(q) for q in QS))
        own = own.select(*key, "prediction", *(F.when(whole, F.col(q)).alias(q) for q in QS))
        parts.append(cases.join(own, key, "left").withColumn("method", F.lit(name)))
    return spark.sql(dialect.write(STANDARD, dialect.SPARK), w=reduce(DataFrame.unionByName, parts))


STANDARD = f"""
    SELECT {', '.join(KEY)}, method, exp(truth) - 1 AS truth, exp(prediction) - 1 AS prediction, truth AS truth_working, prediction AS prediction_working,
           exp(latest) - 1 AS provisional_value, latest AS provisional_working, truth - latest AS true_remaining_revision, prediction - latest AS predicted_remaining_revision,
           prediction IS NOT NULL AS model_available, q0_01 IS NOT NULL AS has_distribution,
           abs(exp(truth) - exp(prediction)) AS absolute_error, abs(truth - prediction) AS absolute_error_working, {wis('truth')} AS wis_working,
           {', '.join(f'exp({q}) - 1 AS {q}' for q in QS)}, {', '.join(f'{q} AS {q}_working' for q in QS)}
    FROM {{w}}
"""


def evaluate(spark: SparkSession, name: str, sf_dir: str | None = None, names: tuple[str, ...] | None = None, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Any model over the long table, with the named methods in place of the usual ones."""
    return run(spark, name, sf_dir, dict(given or {}) | {"standardize_predictions": long_table(spark, sf_dir, names, given)})


register("carry_forward", "carry_forward")
register("median_remaining", "register_method")
register("donor", "donor_forecast")
register("quantile_local", "quantile_fit", method="quantile_local")
register("quantile_global", "quantile_fit", method="quantile_global")


@register("external")
def _external(spark: SparkSession, sf_dir: str | None, given: dict[str, DataFrame] | None) -> DataFrame:
    return run(spark, "external_predictions", sf_dir, given).withColumnRenamed("external", "prediction")



def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered method on the cases that all of a pair with carry-forward have: n, available, mean errors, WIS, and the check loss of each level."""
    rows = long_table(spark, sf_dir)
    losses = [F.avg(F.expr(f"greatest({t} * (truth_working - {q}_working), ({t} - 1) * (truth_working - {q}_working))")).alias(f"loss_{q}") for t, q in zip(TAUS, QS)]
    out = rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("model_available").alias("available"), F.count_if("has_distribution").alias("probabilistic"), F.avg("absolute_error_working").alias("mean_ae"), F.avg("wis_working").alias("mean_wis"),
        F.avg(F.when(F.col("model_available"), F.abs(F.col("true_remaining_revision")))).alias("mean_null_ae"), *losses,
    )
    return rounded(out, 6)


QUERIES = {"method_scores": method_scores}
