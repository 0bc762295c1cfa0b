"""Draws with replacement in proportion to weights, as running sums over buckets and stretches of the line of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dialect
from ..storage import stored

#: Rows that a stretch of the line has on average.
STRETCH = 200
KEY = ["fold", "lag_group", "target"]


def resample(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """fold, lag_group, target, draw, geo_value, reference_date, lag: as many draws for each target and lag group as it has rows.

    Rows lie on a line in order of location, date and lag, as long as their weights are; a draw's place is a hash, and it
    falls to the row that lies there. A location's month is a bucket: buckets are summed before rows are, and a draw
    looks no further than its stretch of the line, so that no task holds a target.
    """
    rows = weights.join(F.broadcast(groups), F.expr("lag BETWEEN lo - 1 AND hi + 1")).select(*KEY, "geo_value", "reference_date", "lag", F.round(F.col("weight") * 1e6).cast("long").alias("weight"))
    rows = stored(rows.withColumn("month", F.trunc("reference_date", "month")), "weights")
    bucket = [*KEY, "geo_value", "month"]
    earlier = Window.partitionBy(*KEY).orderBy("geo_value", "month").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEY)
    sums = rows.groupBy(*bucket).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select(*bucket, before("w").alias("w_before"), before("n").alias("n_before"), F.sum("w").over(whole).alias("total"), F.sum("n").over(whole).alias("rows"))
    own = Window.partitionBy(*bucket).orderBy("reference_date", "lag")
    placed = rows.join(sums.hint("merge"), bucket).where("total > 0").withColumns({"place": F.col("n_before") + F.row_number().over(own), "upto": F.col("w_before") + F.sum("weight").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.withColumn("width", F.expr(f"greatest(1L, total div greatest(1L, rows div {STRETCH}))"))
    placed = stored(placed.select(*KEY, "geo_value", "reference_date", "lag", "weight", "place", "upto", "total", "width"), "placed")
    row = F.struct("geo_value", "reference_date", "lag")
    lying = placed.where("weight > 0").withColumn("stretch", F.explode(F.expr("sequence((upto - weight) div width, (upto - 1) div width)")))
    lying = lying.select(*KEY, "stretch", F.greatest(F.col("upto") - F.col("weight"), F.col("stretch") * F.col("width")).alias("spot"), F.lit(None).cast("long").alias("draw"), row.alias("row"))
    hashed = F.expr(dialect.write("{hex48(concat('resample:', CAST(fold AS STRING), ':', lag_group, ':', target, ':', CAST(place AS STRING)))} % total", dialect.SPARK))
    drawn = placed.withColumn("spot", hashed).select(*KEY, F.expr("spot div width").alias("stretch"), "spot", F.col("place").alias("draw"), F.lit(None).cast(lying.schema["row"].dataType).alias("row"))
    line = Window.partitionBy(*KEY, "stretch").orderBy("spot", F.col("draw").isNotNull(), "draw").rowsBetween(Window.unboundedPreceding, 0)
    met = lying.unionByName(drawn).withColumn("row", F.last("row", ignorenulls=True).over(line)).where("draw IS NOT NULL")
    return met.select(*KEY, "draw", "row.*")
