"""Ranks, shares and exact percentiles of groups of any size.

Values are counted first, so ties are one row. The counts are dealt out by range, each range sums what it has, and what
lies in the ranges before is added: no window or hash map holds a group, only a range of it. What is looked up of a
value then goes back to the rows by a join, for which the few frequent values are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: A value is frequent if it is more than one row in so many; so many at most are broadcast.
SHARE = 1000


def cumulated(counts: DataFrame, group: list[str], x: str) -> DataFrame:
    """counts (group, x, n; a row for each value) with upto, the rows of the group up to the value, and total."""
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counts.repartitionByRange(ranges, *group, x).withColumn("_range", F.spark_partition_id()), "counts")
    w = Window.partitionBy(*group)
    sums = dealt.groupBy(*group, "_range").agg(F.sum("n").alias("_sum"))
    sums = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(w).alias("total"))
    joined = dealt.join(sums.hint("merge"), [*group, "_range"])
    within = F.sum("n").over(Window.partitionBy(*group, "_range").orderBy(x))
    return joined.select(*group, x, "n", (F.col("_before") + within).alias("upto"), "total")


def looked_up(rows: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of values, one row for each value with its number n of rows; the values should be written."""
    total = values.agg(F.sum("n").alias("_all"))
    frequent = values.crossJoin(F.broadcast(total)).where(F.col("n") * SHARE > F.col("_all")).drop("_all")
    rest = rows.join(F.broadcast(frequent.select(on)), on, "left_anti").join(values.hint("merge"), on)
    return rows.join(F.broadcast(frequent), on).unionByName(rest).drop("n")


def ranked(rows: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with the average rank, from 1, of columns within groups; columns: each one's name for the name of its rank. None may be null."""
    for x, name in columns.items():
        counts = cumulated(rows.groupBy(*group, x).agg(F.count(F.lit(1)).alias("n")), group, x)
        values = stored(counts.select(*group, x, "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name)), "ranks")
        rows = looked_up(rows, values, [*group, x])
    return rows


def correlation(a: str, b: str) -> Column:
    """Of two ranks within a group; null where one of them does not vary."""
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(varies, F.covar_pop(a, b) / F.when(spread != 0, spread))


def percentiles(rows: DataFrame, group: list[str], x: str, levels: dict[str, float]) -> DataFrame:
    """group and a column for each level: exact percentiles with linear interpolation. Null values do not count."""
    known = rows.where(F.col(x).isNotNull())
    return at_levels(cumulated(known.groupBy(*group, x).agg(F.count(F.lit(1)).alias("n")), group, x), group, x, levels)


def at_levels(values: DataFrame, group: list[str], x: str, levels: dict[str, float]) -> DataFrame:
    """The same of values that are cumulated already."""
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    low = {c: F.floor(place(p)) for c, p in levels.items()}
    high = {c: F.ceil(place(p)) for c, p in levels.items()}
    holds = lambda i: (F.col("upto") - F.col("n") <= i) & (i < F.col("upto"))
    # of a group only the values at the places asked for are left before they meet
    some = values.where(reduce(lambda a, b: a | b, [holds(i) for i in (*low.values(), *high.values())]))
    found = some.groupBy(*group).agg(F.max("total").alias("total"), *(F.max(F.when(holds(d[c]), F.col(x))).alias(f"_{k}_{c}") for k, d in (("l", low), ("h", high)) for c in levels))
    between = lambda c: F.col(f"_l_{c}") + (F.col(f"_h_{c}") - F.col(f"_l_{c}")) * (place(levels[c]) - low[c])
    return found.select(*group, *(between(c).cast("double").alias(c) for c in levels))
