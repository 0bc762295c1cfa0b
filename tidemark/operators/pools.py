"""Coherent pools of tasks, and what trains from them.

Pairs of tasks that are near enough make a graph. A pool never spans two of its components, so components are found
first, by labels that spread along edges, and the linkage runs within each.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored


def linkage(n: int, near: dict[tuple[int, int], float]) -> list[int]:
    """Greedy complete linkage of n sorted tasks: near has the distance of each admissible pair (i < j) of their places.

    Two pools merge if every pair between them is admissible; the pair of pools whose largest distance is least
    goes first, of equals the one with the smallest places. The result has each task's pool, by its first member.
    """
    of: list[dict[int, float]] = [{} for _ in range(n)]  # of each pool that is left: the pools it may merge with
    for (i, j), d in near.items():
        of[i][j] = of[j][i] = d
    heap = [(d, i, j) for (i, j), d in near.items()]
    heapq.heapify(heap)
    first = list(range(n))
    while heap:
        d, a, b = heapq.heappop(heap)
        if of[a].get(b) != d or first[a] != a or first[b] != b:  # one has merged since, or they are farther now
            continue
        joined = {c: max(x, of[b][c]) for c, x in of[a].items() if c in of[b]}
        for c in of[a].keys() | of[b].keys():
            of[c].pop(a, None)
            of[c].pop(b, None)
        of[a], of[b], first[b] = joined, {}, a
        for c, x in joined.items():
            of[c][a] = x
            heapq.heappush(heap, (x, min(a, c), max(a, c)))
    for i in range(n):
        first[i] = first[first[i]]  # a pool's first member has a smaller place, and is done
    return first


def components(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """tasks (fold, task) with the smallest task of their component: labels go along edges and are looked up again, until none changes."""
    both = stored(edges.select("fold", "a", "b").unionByName(edges.select("fold", F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(tasks.withColumn("label", F.col("task")), "labels")
    while True:
        heard = both.join(labels.select("fold", F.col("task").alias("b"), "label").hint("merge"), ["fold", "b"]).groupBy("fold", F.col("a").alias("task")).agg(F.min("label").alias("heard"))
        told = labels.join(heard.hint("merge"), ["fold", "task"], "left").select("fold", "task", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        own = labels.select("fold", F.col("task").alias("label"), F.col("label").alias("further"))
        new = told.join(own.hint("merge"), ["fold", "label"]).select("fold", "task", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("was")).alias("_new"))
        new = stored(new, "labels")
        changed = not new.where("_new").isEmpty()
        labels = new.drop("_new")
        if not changed:
            return labels


def coherent(tasks: DataFrame, distances: DataFrame, limits: DataFrame) -> DataFrame:
    """fold, geo_value, lag, pool: pools of an origin's tasks, no two of which are farther apart than its threshold.

    Pools are numbered by their first task in order of location and lag.
    """
    task = lambda side: F.struct(F.col(f"{side}geo_value" if not side else f"{side}geo").alias("geo_value"), F.col(f"{side}lag").alias("lag"))
    edges = distances.join(F.broadcast(limits.select("fold", "threshold")), "fold").where("distance <= threshold").select("fold", task("a_").alias("a"), task("b_").alias("b"), "distance")
    edges = stored(edges, "edges")
    known = components(tasks.select("fold", task("").alias("task")), edges)
    pairs = edges.join(known.select("fold", F.col("task").alias("a"), "label").hint("merge"), ["fold", "a"])
    alone = known.select("fold", "label", F.col("task").alias("a"), F.lit(None).cast("struct<geo_value string, lag int>").alias("b"), F.lit(None).cast("double").alias("distance"))
    flat = ["fold", F.col("label.geo_value").alias("first_geo"), F.col("label.lag").alias("first_lag"), F.col("a.geo_value").alias("a_geo"), F.col("a.lag").alias("a_lag"), F.col("b.geo_value").alias("b_geo"), F.col("b.lag").alias("b_lag"), "distance"]

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        single = rows["b_geo"].isna()
        names = sorted({(g, int(n)) for g, n in zip(rows.loc[single, "a_geo"], rows.loc[single, "a_lag"])})
        place = {t: i for i, t in enumerate(names)}
        near: dict[tuple[int, int], float] = {}
        for a, b, c, d, x in rows.loc[~single, ["a_geo", "a_lag", "b_geo", "b_lag", "distance"]].itertuples(index=False):
            i, j = place[(a, int(b))], place[(c, int(d))]
            near[(min(i, j), max(i, j))] = x
        first = [names[i] for i in linkage(len(names), near)]
        return pd.DataFrame({"fold": int(rows["fold"].iloc[0]), "geo_value": [g for g, _ in names], "lag": [n for _, n in names], "pool_geo": [g for g, _ in first], "pool_lag": [n for _, n in first]})

    rows = pairs.select("fold", "label", "a", "b", "distance").unionByName(alone).select(*flat)
    pooled = stored(rows.groupBy("fold", "first_geo", "first_lag").applyInPandas(group, "fold int, geo_value string, lag int, pool_geo string, pool_lag int"), "pooled")
    number = F.expr("CAST(row_number() OVER (PARTITION BY fold ORDER BY pool_geo, pool_lag) - 1 AS INT)").alias("pool")
    numbers = pooled.select("fold", "pool_geo", "pool_lag").distinct().select("fold", "pool_geo", "pool_lag", number)
    return pooled.join(numbers.hint("merge"), ["fold", "pool_geo", "pool_lag"]).select("fold", "geo_value", "lag", "pool")


frame_model("coherent_pools", ("task_prototypes", "task_distance", "nearest_threshold"), coherent, digits=None)
model("pool_summary", """
    WITH p AS (SELECT fold, pool, count(*) AS n, count(DISTINCT geo_value) AS locations, count(DISTINCT lag) AS lags FROM {coherent_pools} GROUP BY fold, pool)
    SELECT fold, CAST(sum(n) AS BIGINT) AS tasks, CAST(count(*) AS BIGINT) AS pools, power(sum(n), 2) / sum(n * n) AS effective_pools,
           100 * avg(CASE WHEN locations > 1 THEN 1e0 ELSE 0e0 END) AS multi_location_percent, 100 * avg(CASE WHEN lags > 1 THEN 1e0 ELSE 0e0 END) AS multi_lag_percent,
           100 * avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END) AS singleton_percent,
           100 * sum(CASE WHEN locations > 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS multi_location_task_percent,
           100 * sum(CASE WHEN lags > 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS multi_lag_task_percent, 100 * sum(CASE WHEN n = 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS singleton_task_percent
    FROM p GROUP BY fold
""")
model("pool_rows", """
    SELECT t.fold, p.pool, t.geo_value, t.reference_date, t.report_date, t.lag, t.remaining
    FROM {completed_training} t JOIN {coherent_pools} p ON p.fold = t.fold AND p.geo_value = t.geo_value AND p.lag = t.lag WHERE t.strict
""", public=False)
# where a pool trains: on its own rows if there are ten, else on all rows at its lags if there are ten, else on all rows
model("small_pool_fallback", """
    WITH q AS (SELECT DISTINCT fold, pool FROM {coherent_pools}), own AS (SELECT fold, pool, count(*) AS n FROM {pool_rows} GROUP BY fold, pool),
    at_lag AS (SELECT fold, lag, count(*) AS n FROM {completed_training} WHERE strict GROUP BY fold, lag),
    near AS (SELECT p.fold, p.pool, sum(a.n) AS n FROM (SELECT DISTINCT fold, pool, lag FROM {coherent_pools}) p JOIN at_lag a ON a.fold = p.fold AND a.lag = p.lag GROUP BY p.fold, p.pool)
    SELECT q.fold, q.pool, CAST(coalesce(own.n, 0) AS BIGINT) AS own_rows, CAST(coalesce(near.n, 0) AS BIGINT) AS rows_at_lags,
           CASE WHEN coalesce(own.n, 0) >= 10 THEN 'pool' WHEN coalesce(near.n, 0) >= 10 THEN 'lags of the pool' ELSE 'all' END AS trains_on
    FROM q LEFT JOIN own ON own.fold = q.fold AND own.pool = q.pool LEFT JOIN near ON near.fold = q.fold AND near.pool = q.pool
""")
model("train_sets_pooled", """
    SELECT r.fold, r.pool, r.geo_value, r.reference_date, r.report_date, r.lag, r.remaining, f.trains_on
    FROM {pool_rows} r JOIN {small_pool_fallback} f ON f.fold = r.fold AND f.pool = r.pool WHERE f.trains_on = 'pool'
    UNION ALL
    SELECT f.fold, f.pool, t.geo_value, t.reference_date, t.report_date, t.lag, t.remaining, f.trains_on
    FROM {small_pool_fallback} f JOIN (SELECT DISTINCT fold, pool, lag FROM {coherent_pools}) p ON p.fold = f.fold AND p.pool = f.pool
    JOIN {completed_training} t ON t.fold = f.fold AND t.lag = p.lag WHERE f.trains_on = 'lags of the pool' AND t.strict
    UNION ALL
    SELECT f.fold, f.pool, t.geo_value, t.reference_date, t.report_date, t.lag, t.remaining, f.trains_on
    FROM {small_pool_fallback} f JOIN {completed_training} t ON t.fold = f.fold WHERE f.trains_on = 'all' AND t.strict
""")
