"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .models import MODELS, in_sql, oracle, rounded, run
from .operators import archive, assess, backtest, calibrate, clusters, compare, donors, external, forecast, methods, monitor, pooling, pools, quantiles, smooth, triangle  # noqa: F401
from .plans.doubles import DOUBLES
from .sources import archives, files  # noqa: F401


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(run(spark, name, sf_dir), MODELS[name].digits)

    query.__name__ = name
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {m.name: _query(m.name) for m in MODELS.values() if m.public}
QUERIES |= files.QUERIES | methods.QUERIES | external.QUERIES
SQL: dict[str, str] = {name: oracle(name, DOUBLES.get(name, "").split()) for name in QUERIES if name in MODELS and in_sql(name)}
