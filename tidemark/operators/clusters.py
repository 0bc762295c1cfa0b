"""Soft clusters of locations by their reporting profiles: k-means of every origin and band at once, memberships, and routes by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored

#: Clusters at most, rounds at most, width of a membership's bell, and the seed of the first center.
CLUSTERS, ROUNDS, WIDTH, SEED = 3, 50, 1.0, 2026
_D2 = "aggregate(zip_with(z, center, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)"
_GROUP = ["fold", "band"]


def _centers(points: DataFrame) -> DataFrame:
    """fold, band, cluster, center: a location drawn by hash, then each time the one farthest from all centers, as long as it is apart."""
    draw = F.xxhash64(F.lit(SEED), "fold", "band", "geo_value")
    found = [points.groupBy(*_GROUP).agg(F.min_by("z", F.struct(draw, "geo_value")).alias("center")).withColumn("cluster", F.lit(1))]
    for k in range(2, CLUSTERS + 1):
        apart = points.join(reduce(DataFrame.unionByName, found).hint("merge"), _GROUP).groupBy(*_GROUP, "geo_value", "z").agg(F.min(F.expr(_D2)).alias("d2"))
        far = apart.groupBy(*_GROUP).agg(F.max("d2").alias("d2"), F.max_by("z", F.struct("d2", "geo_value")).alias("center")).where("d2 > 0")
        found.append(stored(far.select(*_GROUP, "center", F.lit(k).alias("cluster")), "centers"))
    return stored(reduce(DataFrame.unionByName, found), "centers")


def memberships(standardized: DataFrame) -> DataFrame:
    """fold, band, geo_value, cluster, membership. Rounds go on until no center of any origin and band moves; one of fewer than
    CLUSTERS different profiles has as many clusters as these."""
    points = standardized.groupBy(*_GROUP, "geo_value").agg(F.transform(F.sort_array(F.collect_list(F.struct("metric", "z"))), lambda x: F.round(x["z"], 9)).alias("z"))
    points = stored(points, "points")
    centers = _centers(points)
    for _ in range(ROUNDS):
        near = points.join(centers.hint("merge"), _GROUP).groupBy(*_GROUP, "geo_value", "z").agg(F.min_by("cluster", F.struct(F.expr(_D2), "cluster")).alias("cluster"))
        means = near.select(*_GROUP, "cluster", F.posexplode("z").alias("at", "v")).groupBy(*_GROUP, "cluster", "at").agg(F.avg("v").alias("v"))
        means = means.groupBy(*_GROUP, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: F.round(x["v"], 12)).alias("mean"))
        # a center that no location is nearest to stays where it is
        new = stored(centers.join(means.hint("merge"), [*_GROUP, "cluster"], "left").select(*_GROUP, "cluster", F.coalesce("mean", "center").alias("center"), F.coalesce(F.col("mean") != F.col("center"), F.lit(False)).alias("moved")), "centers")
        centers = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    near = points.join(centers.hint("merge"), _GROUP).withColumn("d2", F.expr(_D2))
    least = near.groupBy(*_GROUP, "geo_value").agg(F.min("d2").alias("least"))
    bell = near.join(least.hint("merge"), [*_GROUP, "geo_value"]).withColumn("m", F.exp((F.col("least") - F.col("d2")) / (2 * WIDTH**2)))
    total = bell.groupBy(*_GROUP, "geo_value").agg(F.sum("m").alias("total"))
    return bell.join(total.hint("merge"), [*_GROUP, "geo_value"]).select(*_GROUP, "geo_value", "cluster", (F.col("m") / F.col("total")).alias("membership"))


frame_model("cluster_memberships", ("profile_standardize",), memberships)
# a route's weight: what two locations' memberships have in common, as a share of the target's
model("soft_cluster_routes", """
    WITH w AS (
      SELECT a.fold, a.band, a.geo_value AS target, b.geo_value AS source, sum(a.membership * b.membership) AS weight
      FROM {cluster_memberships} a JOIN {cluster_memberships} b ON b.fold = a.fold AND b.band = a.band AND b.cluster = a.cluster GROUP BY a.fold, a.band, a.geo_value, b.geo_value),
    t AS (SELECT fold, band, target, sum(weight) AS total FROM w GROUP BY fold, band, target)
    SELECT w.fold, w.band, w.target, w.source, w.weight / t.total AS weight FROM w JOIN t ON t.fold = w.fold AND t.band = w.band AND t.target = w.target
""")
