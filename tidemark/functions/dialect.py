"""The few expressions that Spark SQL and DuckDB write differently, as macros {name(arg; arg)} in a model's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

SPARK: dict[str, Callable[..., str]] = {
    "days": lambda later, earlier: f"datediff({later}, {earlier})",
    "plus": lambda d, n: f"date_add({d}, CAST({n} AS INT))",
    "weekday": lambda d: f"weekday({d})",
    "pct": lambda x, p: f"percentile({x}, {p})",
    "hex48": lambda s: f"CAST(conv(substr(md5({s}), 1, 12), 16, 10) AS BIGINT)",
    "numbers": lambda a, b: f"(SELECT explode(sequence({a}, {b})) AS i)",
    "semi": lambda _: "LEFT SEMI JOIN",
    "last": lambda x: f"last_value({x}, true)",
    "steps": lambda last, step: f"explode(sequence(0, {last}, {step}))",
    "series": lambda a, b: f"explode(sequence({a}, {b}))",
    "cell": lambda x, n: f"CAST(({x}) div ({n}) AS INT)",
    "refuse": lambda why: f"CASE WHEN {why} IS NOT NULL THEN raise_error({why}) ELSE TRUE END",
}
DUCKDB: dict[str, Callable[..., str]] = {
    "days": lambda later, earlier: f"CAST(date_diff('day', {earlier}, {later}) AS INTEGER)",
    "plus": lambda d, n: f"CAST({d} + CAST({n} AS INTEGER) AS DATE)",
    "weekday": lambda d: f"CAST(isodow({d}) - 1 AS INTEGER)",
    "pct": lambda x, p: f"quantile_cont({x}, {p})",
    "hex48": lambda s: f"CAST('0x' || substr(md5({s}), 1, 12) AS BIGINT)",
    "numbers": lambda a, b: f"(SELECT CAST(unnest(range({a}, {b} + 1)) AS INTEGER) AS i)",
    "semi": lambda _: "SEMI JOIN",
    "last": lambda x: f"last_value({x} IGNORE NULLS)",
    "steps": lambda last, step: f"CAST(unnest(range(0, {last} + 1, {step})) AS INTEGER)",
    "series": lambda a, b: f"CAST(unnest(range({a}, {b} + 1)) AS INTEGER)",
    "cell": lambda x, n: f"CAST(({x}) // ({n}) AS INTEGER)",
    "refuse": lambda why: f"CASE WHEN {why} IS NOT NULL THEN error({why}) ELSE TRUE END",
}
_MACRO = re.compile(r"\{(\w+)\(([^{}]*)\)\}")


def write(sql: str, dialect: dict[str, Callable[..., str]]) -> str:
    """sql with its macros written in a dialect; macros may hold macros."""
    while True:
        done = _MACRO.sub(lambda m: dialect[m[1]](*(a.strip() for a in m[2].split(";"))), sql)
        if done == sql:
            return done
        sql = done
