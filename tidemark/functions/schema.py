"""Checks and renames that come before any model: refusals are errors, and say what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARCHIVE = ("geo_value", "reference_date", "report_date", "value")


def map_columns(df: DataFrame, names: dict[str, str], fields: tuple[str, ...] = ARCHIVE) -> DataFrame:
    """df with source columns renamed to fields: names maps each field to its source.

    Refused: a field without a source, a source that is not there, and a name that another column has already.
    """
    if missing := [f for f in fields if f not in names and f not in df.columns]:
        raise ValueError(f"no source for {', '.join(missing)}")
    if absent := [s for s in names.values() if s not in df.columns]:
        raise ValueError(f"no column {', '.join(absent)}")
    if taken := [f for f, s in names.items() if f != s and f in df.columns and f not in names.values()]:
        raise ValueError(f"there is a column {', '.join(taken)} already")
    return df.withColumnsRenamed({s: f for f, s in names.items()})


def normalize_lag_types(df: DataFrame, nullable: tuple[str, ...] = ("target_lag",)) -> DataFrame:
    """df with lag and target_lag as integers; fractional ones are errors, and so are missing lags. One pass over the rows."""
    lags = [c for c in ("lag", "target_lag") if c in df.columns]
    wrong = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("double") != F.floor(F.col(c).cast("double")))).alias(f"{c} has fractions") for c in lags]
    wrong += [F.count_if(F.col(c).isNull()).alias(f"{c} has gaps") for c in lags if c not in nullable]
    if lags and (found := [k for k, n in df.agg(*wrong).first().asDict().items() if n]):
        raise ValueError("; ".join(found))
    return df.withColumns({c: F.col(c).cast("int") for c in lags})


def derive_transform(df: DataFrame, column: str = "log_value_7dav") -> str:
    """'log' if the column has a numerator and a denominator beside it, else 'log1p', whose values may not be negative."""
    if f"{column}_num" in df.columns and f"{column}_denom" in df.columns:
        return "log"
    low = df.agg(F.min(F.when(~F.isnan(F.col(column).cast("double")), F.col(column)))).first()[0]
    if low is not None and low < 0:
        raise ValueError(f"{column} is below zero, so it is no log1p of a count")
    return "log1p"


def numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
