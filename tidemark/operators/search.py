"""Distances between tasks where a search stands, and nowhere else.

Every search walks along a location's tasks from one that is given. All walks of all origins go on together: a round
gives each walk that is still open its next STRIDE tasks, works out those distances, and folds them into the walk's
state. So the distances that are made are those that the walks ask for, and at most STRIDE - 1 more for each walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

STRIDE = 4
_PROFILE = ("median_gap", "zero_share", "median_step", "median_abs_step", "mad_step")


def vectors(prototypes: DataFrame, courses: DataFrame) -> DataFrame:
    """A row for each task: fold, geo_value, lag, place among its location's lags from 0, profile, course, stage."""
    own = courses.groupBy("fold", "geo_value", "lag").agg(F.transform(F.sort_array(F.collect_list(F.struct("from_lag", "step"))), lambda x: x["step"]).alias("course"))
    place = F.expr("CAST(row_number() OVER (PARTITION BY fold, geo_value ORDER BY lag) - 1 AS INT)").alias("place")
    return prototypes.join(own.hint("merge"), ["fold", "geo_value", "lag"]).select("fold", "geo_value", "lag", place, F.array(*_PROFILE).alias("profile"), "course", "stage")


_SQUARES = "aggregate(zip_with({x}, {y}, (u, v) -> (u - v) * (u - v)), 0D, (s, z) -> s + z)"
_COMMON = "least(size(a_course), size(b_course))"
D_PROFILE = f"round(sqrt({_SQUARES.format(x='a_profile', y='b_profile')}), 9)"
D_COURSE = f"round(sqrt({_SQUARES.format(x=f'slice(a_course, 1, {_COMMON})', y=f'slice(b_course, 1, {_COMMON})')} / {_COMMON}), 10)"
D_STAGE = "round(abs(a_stage - b_stage), 10)"


def _with(rows: DataFrame, tasks: DataFrame, side: str, on: dict[str, str]) -> DataFrame:
    """rows with the vector of a task beside them. on: columns of rows for the task's."""
    own = tasks.select(*(F.col(t).alias(f"_{t}") for t in on.values()), *(F.col(c).alias(f"{side}_{c}") for c in ("profile", "course", "stage", "lag") if c != "lag" or "lag" not in on.values()))
    match = reduce(lambda x, y: x & y, (F.col(r) == F.col(f"_{t}") for r, t in on.items()))
    return rows.join(own.hint("merge"), match).drop(*(f"_{t}" for t in on.values()))


def components(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """The three parts of the distance of each edge."""
    both = _with(_with(edges, tasks, "a", {"fold": "fold", "a_geo": "geo_value", "a_lag": "lag"}), tasks, "b", {"fold": "fold", "b_geo": "geo_value", "b_lag": "lag"})
    return both.select("fold", "a_geo", "a_lag", "b_geo", "b_lag", F.expr(D_STAGE).alias("d_stage"), F.expr(D_PROFILE).alias("d_profile"), F.expr(D_COURSE).alias("d_course"))


def walk(tasks: DataFrame, scales: DataFrame, limits: DataFrame) -> DataFrame:
    """fold, geo_value, lag, other_geo, other_lag, distance: what the searches from each task asked for.

    In its own location a walk ends with two distances beyond the limit in a row. In another one it starts beside the
    task of the same lag, ends at once where the first step is no nearer than that, and then with two in a row beyond the
    limit of which the second is no nearer than all before; without a task of that lag it starts at the nearest on each side.
    """
    origin = scales.join(limits.select("fold", "threshold"), "fold").select("fold", "threshold", *(F.col(d).alias(f"s_{d[2:]}") for d in ("d_profile", "d_course", "d_stage")))
    lists = tasks.groupBy("fold", F.col("geo_value").alias("other_geo")).agg(F.sort_array(F.collect_list("lag")).alias("lags"))
    pairs = tasks.select("fold", "geo_value", "lag").join(lists.hint("merge"), "fold").withColumn("below", F.expr("size(filter(lags, x -> x < lag))")).withColumn("there", F.expr("array_contains(lags, lag)"))
    same = F.col("geo_value") == F.col("other_geo")

    def measured(rows: DataFrame) -> DataFrame:
        """rows with distances to the tasks at `at` of the other locations; places that are not there are left out."""
        both = _with(_with(rows, tasks, "b", {"fold": "fold", "other_geo": "geo_value", "at": "place"}), tasks, "a", {"fold": "fold", "geo_value": "geo_value", "lag": "lag"})
        both = both.join(F.broadcast(origin.select("fold", "s_profile", "s_course", "s_stage")), "fold")
        parts = [f"({d} / s_{n}) * ({d} / s_{n})" for d, n in ((D_PROFILE, "profile"), (D_COURSE, "course"), (D_STAGE, "stage"))]
        return both.withColumn("d", F.expr(f"round(sqrt({' + '.join(parts)}), 6)"))

    centers = stored(measured(pairs.where(~same & F.col("there")).withColumn("at", F.col("below"))).select("fold", "geo_value", "lag", "other_geo", F.col("b_lag").alias("other_lag"), F.col("d").alias("distance")), "walk")
    key = ["fold", "geo_value", "lag", "other_geo"]
    begun = pairs.join(centers.select(*key, "distance").hint("merge"), key, "left").join(F.broadcast(origin.select("fold", "threshold")), "fold")
    begun = begun.select(
        *key, "threshold", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"), "below", "there",
        # in its own location nothing counts as nearer
        F.when(same, F.lit(-1.0)).when(F.col("there"), F.col("distance")).otherwise(F.lit(1e300)).alias("best"), F.lit(False).alias("beyond"), (~same & F.col("there")).alias("fresh"),
    )
    at = F.when(F.col("way") == 1, F.col("below") + F.col("there").cast("int")).otherwise(F.col("below") - 1)
    state = stored(begun.withColumn("at", at).drop("below", "there"), "walk")
    asked = [centers]
    fold = """aggregate(xs, named_struct('best', best, 'beyond', beyond, 'fresh', fresh, 'closed', false, 'seen', 0),
        (s, x) -> CASE WHEN s.closed THEN s ELSE named_struct('best', least(s.best, x.d), 'beyond', x.d > threshold, 'fresh', false,
                       'closed', CASE WHEN s.fresh THEN NOT x.d < s.best ELSE x.d > threshold AND s.beyond AND NOT x.d < s.best END, 'seen', s.seen + 1) END)"""
    while not state.isEmpty():
        ahead = state.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STRIDE - 1)))).withColumn("at", F.col("at") + F.col("way") * F.col("k"))
        found = measured(ahead).groupBy(*key, "way", "threshold", "best", "beyond", "fresh").agg(F.sort_array(F.collect_list(F.struct("k", "d", "b_lag", "at"))).alias("xs"))
        made = stored(found.withColumn("s", F.expr(fold)), "walk")
        asked.append(made.select(*key, F.explode(F.expr("slice(xs, 1, s.seen)")).alias("x")).select(*key, F.col("x.b_lag").alias("other_lag"), F.col("x.d").alias("distance")))
        going = made.where(f"NOT s.closed AND size(xs) = {STRIDE}")
        state = going.select(*key, "threshold", "way", "s.best", "s.beyond", "s.fresh", (F.element_at("xs", -1)["at"] + F.col("way")).alias("at"))
    return reduce(DataFrame.unionByName, asked).select("fold", "geo_value", "lag", "other_geo", "other_lag", "distance")
