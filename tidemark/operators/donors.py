"""Donor matching: how completed episodes of any location went on from a like stage weighs their revisions.

Curves are interpolated by monotone cubics (PCHIP) whose slopes need only neighbouring releases; donors are all rows
completed before the origin. Cases of a (location, lag) share all of a donor's distance but its state's part, so they
meet the donors once and together: first those of their own location and lag, which bounds how far the nearest is, then
the donors of locations and lags within REACH of that. What is beyond has less than a billionth of the weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored
from . import order
from .forecast import QS, TAUS

GAMMA, LAST = "1e0", 28
#: Squared distance beyond the nearest donor's, besides the logarithm of the donors' number; cases that meet donors at a time.
REACH, TOGETHER = 25.0, 512

model("knots", f"""
    WITH k AS (
      SELECT t.geo_value, t.reference_date, t.lag, t.log_value_7dav AS y FROM {{triangle}} t WHERE t.lag < {LAST} AND t.target_date IS NOT NULL
      UNION ALL SELECT geo_value, reference_date, {LAST}, ln(1 + target_value) FROM {{delayed_target}}),
    s AS (
      SELECT *, min(lag) OVER e AS first_lag, (lead(lag) OVER w) - lag AS h, ((lead(y) OVER w) - y) / ((lead(lag) OVER w) - lag) AS d FROM k
      WINDOW e AS (PARTITION BY geo_value, reference_date), w AS (PARTITION BY geo_value, reference_date ORDER BY lag)),
    n AS (
      SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp
      FROM s WHERE first_lag = 0 WINDOW w AS (PARTITION BY geo_value, reference_date ORDER BY lag)),
    e AS (
      SELECT *, CASE WHEN h IS NULL AND hpp IS NULL THEN dp WHEN h IS NULL THEN ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp) WHEN hp IS NULL AND hn IS NULL THEN d
                     WHEN hp IS NULL THEN ((2 * h + hn) * d - h * dn) / (h + hn) END AS edge,
             CASE WHEN h IS NULL THEN dp ELSE d END AS own, CASE WHEN h IS NULL THEN dpp ELSE dn END AS other
      FROM n)
    SELECT geo_value, reference_date, lag, y, h,
           CASE WHEN h IS NOT NULL AND hp IS NOT NULL THEN CASE WHEN dp * d <= 0 THEN 0e0 ELSE 3e0 * (h + hp) / ((2e0 * h + hp) / dp + (h + 2e0 * hp) / d) END
                WHEN edge * own <= 0 THEN 0e0 WHEN other IS NOT NULL AND own * other <= 0 AND abs(edge) > 3 * abs(own) THEN 3 * own ELSE edge END AS m
    FROM e
""", public=False)
model("episode_curves", f"""
    WITH k AS (SELECT *, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM {{knots}} WINDOW w AS (PARTITION BY geo_value, reference_date ORDER BY lag)),
    g AS (SELECT /*+ BROADCAST(n) */ k.*, CAST(n.i AS INT) AS grid_lag, (n.i - k.lag) / CAST(coalesce(k.h, 1) AS DOUBLE) AS u FROM k JOIN {{numbers(0; {LAST})}} n ON n.i >= k.lag AND (n.i < k.lag + k.h OR k.h IS NULL AND n.i = k.lag)),
    p AS (
      SELECT geo_value, reference_date, grid_lag, CASE WHEN h IS NULL OR u = 0 THEN y ELSE (1 + 2 * u) * (1 - u) * (1 - u) * y + u * (1 - u) * (1 - u) * h * m + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * h * m1 END AS y FROM g)
    SELECT p.geo_value, p.reference_date, p.grid_lag AS lag, ln(1 + t.target_value) - p.y AS remaining FROM p JOIN {{delayed_target}} t ON t.geo_value = p.geo_value AND t.reference_date = p.reference_date
""".replace(f"{{numbers(0; {LAST})}}", "{numbers(0; 28)}"))
model("location_curves", """
    WITH c AS (
      SELECT /*+ BROADCAST(s) */ s.fold, s.cutoff, e.* FROM {episode_curves} e JOIN {schedule} s
        ON {plus(e.reference_date; 28)} <= s.cutoff AND {plus(e.reference_date; 28)} > {plus(s.cutoff; 0 - s.training_days)}),
    i AS (SELECT fold, geo_value, {pct(abs(remaining); 5e-1)} + 1e-8 AS size, count(*) AS n FROM c WHERE lag = 0 GROUP BY fold, geo_value)
    SELECT c.fold, c.cutoff, c.geo_value, c.lag, {pct(c.remaining; 5e-1)} / max(i.size) AS curve, abs({pct(c.remaining; 5e-1)} / max(i.size)) AS position, CAST(max(i.n) AS BIGINT) AS episodes
    FROM c JOIN i ON i.fold = c.fold AND i.geo_value = c.geo_value WHERE i.n >= 3 GROUP BY c.fold, c.cutoff, c.geo_value, c.lag
""")
model("curve_pairs", """
    SELECT a.fold, a.geo_value, b.geo_value AS donor_geo, sqrt(avg((a.curve - b.curve) * (a.curve - b.curve))) AS distance
    FROM {location_curves} a JOIN {location_curves} b ON b.fold = a.fold AND b.lag = a.lag GROUP BY a.fold, a.geo_value, b.geo_value
""", public=False)
model("curve_scale", """
    SELECT fold, {pct(distance; 5e-1)} + 1e-8 AS curve_scale, CAST(count(*) AS BIGINT) AS pairs FROM {curve_pairs} WHERE geo_value < donor_geo GROUP BY fold
""")
model("stage_scale", """
    WITH r AS (SELECT fold, position, row_number() OVER (PARTITION BY fold ORDER BY position, geo_value, lag) AS place FROM {location_curves})
    SELECT a.fold, {pct(abs(a.position - b.position); 5e-1)} + 1e-8 AS stage_scale FROM r a JOIN r b ON b.fold = a.fold AND a.place < b.place GROUP BY a.fold
""")
model("donors", """
    SELECT DISTINCT t.fold, t.geo_value, t.reference_date, t.lag, t.remaining, d.log_delta_value_7dav_lag7 AS state
    FROM {completed_training} t LEFT JOIN {triangle} d ON d.geo_value = t.geo_value AND d.reference_date = t.reference_date AND d.report_date = t.report_date AND d.lag = t.lag
    WHERE t.lag BETWEEN 0 AND 28
""")


def _mad(donors: DataFrame, schedule: DataFrame) -> DataFrame:
    """1.4826 times the median distance from the median state of each origin's donors; 1 where there is none."""
    states = donors.where("state IS NOT NULL").select("fold", "state")
    center = order.percentiles(states, ["fold"], "state", {"center": 0.5})
    apart = states.join(F.broadcast(center), "fold").select("fold", F.abs(F.col("state") - F.col("center")).alias("apart"))
    mad = order.percentiles(apart, ["fold"], "apart", {"mad": 0.5})
    return schedule.select("fold").join(F.broadcast(mad), "fold", "left").select("fold", F.coalesce(F.greatest(F.col("mad") * 1.4826, F.lit(1e-8)), F.lit(1.0)).alias("scale"))


frame_model("mad_scale", ("donors", "schedule"), _mad, sql="""
    WITH c AS (SELECT fold, {pct(state; 5e-1)} AS center FROM {donors} WHERE state IS NOT NULL GROUP BY fold)
    SELECT s.fold, coalesce(greatest(m.scale, 1e-8), 1e0) AS scale FROM {schedule} s
    LEFT JOIN (SELECT d.fold, 14826e-4 * {pct(abs(d.state - c.center); 5e-1)} AS scale FROM {donors} d JOIN c ON c.fold = d.fold WHERE d.state IS NOT NULL GROUP BY d.fold) m ON m.fold = s.fold
""")
# distance of each pair of (location, lag) cells, for the oracle
model("task_cells", """
    SELECT a.fold, a.geo_value, a.lag, b.geo_value AS donor_geo, b.lag AS donor_lag,
           coalesce((c.distance / k.curve_scale) * (c.distance / k.curve_scale), 0e0) + ((a.position - b.position) / s.stage_scale) * ((a.position - b.position) / s.stage_scale) AS base
    FROM {location_curves} a JOIN {location_curves} b ON b.fold = a.fold JOIN {curve_pairs} c ON c.fold = a.fold AND c.geo_value = a.geo_value AND c.donor_geo = b.geo_value
    LEFT JOIN {curve_scale} k ON k.fold = a.fold JOIN {stage_scale} s ON s.fold = a.fold
""", public=False)


def _weigh(cases: dict[str, np.ndarray], d: dict[str, np.ndarray], scale: float) -> dict[str, list]:
    """Weights of donors (in order of remaining) for cases of one location and lag, and what they say of what remains."""
    states, known = cases["state"], ~np.isnan(d["state"])
    cold = not cases["curve"][0]
    by_lag = (d["lag"] - cases["lag"][0]) ** 2 / float(LAST) ** 2
    out: dict[str, list] = {k: [] for k in ("donors", "donor_locations", "effective_donors", "largest_weight", "mean_remaining", "fallback", *QS)}
    for state in states:
        active = not np.isnan(state)
        apart = ((state - d["state"]) / scale) ** 2 if active else np.zeros(len(known))
        able = known if active else np.ones(len(known), bool)
        valid = able & ~np.isnan(d["base"])
        if not cold and valid.any():
            d2, fallback = d["base"] + apart, "none"
        else:
            name = "cold start" if cold else "no comparable donor"
            if able.any():
                d2, valid, fallback = apart + by_lag, able, f"{name}, state and lag" if active else f"{name}, lag"
            else:
                d2, valid, fallback = by_lag, np.ones(len(known), bool), f"{name}, lag"
        if not valid.any():
            for k in out:
                out[k].append({"donors": 0, "donor_locations": 0, "fallback": "no donors"}.get(k))
            continue
        d2, y = d2[valid], d["remaining"][valid]
        w = np.exp(float(GAMMA) * (d2.min() - d2))
        total, cumulated = w.sum(), np.cumsum(w)
        at = np.minimum(np.searchsorted(cumulated, np.array([float(t) for t in TAUS]) * total - 1e-9 * total), len(y) - 1)
        out["donors"].append(int(valid.sum()))
        out["donor_locations"].append(len(np.unique(d["place"][valid])))
        out["effective_donors"].append(total * total / (w * w).sum())
        out["largest_weight"].append(w.max() / total)
        out["mean_remaining"].append((w * y).sum() / total)
        out["fallback"].append(fallback)
        for q, v in zip(QS, y[at]):
            out[q].append(float(v))
    return out


_CASE = "fold int, geo_value string, reference_date date, report_date date, lag int, truth double, latest double"
_MATCH = f"{_CASE}, donors long, donor_locations long, effective_donors double, largest_weight double, mean_remaining double, fallback string, {', '.join(f'{q} double' for q in QS)}"


def match(progress: DataFrame, curves: DataFrame, pairs: DataFrame, curve_scale: DataFrame, stage_scale: DataFrame, donors: DataFrame, mad: DataFrame) -> DataFrame:
    """Each case's donors weighed: how many are within reach, how even their weights are, and weighted quantiles of what remained.

    A case without a state leaves its part out; donors without one are no donors for a case that has it. A location
    without a curve is weighed by state and lag, as are cases whose origin has no donor to compare with.
    """
    cell = ["fold", "geo_value", "lag"]
    cases = progress.select("fold", "geo_value", "reference_date", "report_date", "lag", "truth", "latest", F.col("progress").alias("state"))
    places = curves.select(*cell, "position")
    cases = stored(cases.join(places.hint("merge"), cell, "left").withColumn("curve", F.col("position").isNotNull()), "cases")
    origin = mad.join(stage_scale, "fold", "left").join(curve_scale.select("fold", "curve_scale"), "fold", "left")
    origin = stored(origin.join(donors.groupBy("fold").agg(F.count(F.lit(1)).alias("all")), "fold", "left"), "origins")
    mad = origin.select("fold", "scale")
    own = donors.join(places.hint("merge"), cell, "left").select("fold", F.col("geo_value").alias("donor_geo"), F.col("lag").alias("donor_lag"), "remaining", "state", F.col("position").alias("donor_position"))
    own = stored(own, "donors")

    # how far the nearest donor of its own location and lag is from each case, and the farthest of that in a cell
    near = cases.join(own.select("fold", F.col("donor_geo").alias("geo_value"), F.col("donor_lag").alias("lag"), F.col("state").alias("s")).hint("merge"), cell).join(F.broadcast(mad), "fold")
    gap = F.when(F.col("state").isNull(), F.lit(0.0)).otherwise(F.pow((F.col("state") - F.col("s")) / F.col("scale"), 2))
    nearest = near.groupBy(*cell, "reference_date", "report_date").agg(F.min(gap).alias("u"))
    bounds = cases.join(nearest.hint("merge"), [*cell, "reference_date", "report_date"], "left").groupBy(*cell, "position").agg(F.max(F.coalesce("u", F.lit(float("inf")))).alias("u"), F.count(F.lit(1)).alias("cases"))
    bounds = bounds.join(F.broadcast(origin), "fold").withColumn("reach", F.col("u") + REACH + F.log("all"))
    bounds = stored(bounds.withColumn("chunks", F.expr(f"CAST((cases + {TOGETHER - 1}) div {TOGETHER} AS INT)")), "bounds")

    # of a cell with a curve: donors' cells within its reach; the others, and those without a bound, meet all donors of the origin
    cells = own.where("donor_position IS NOT NULL").select("fold", "donor_geo", "donor_lag", "donor_position").distinct()
    curve = F.coalesce(F.pow(F.col("distance") / F.col("curve_scale"), 2), F.lit(0.0))
    some = bounds.where("position IS NOT NULL AND u < double('infinity')").join(pairs.hint("merge"), ["fold", "geo_value"]).withColumn("apart", curve).where("apart <= reach")
    met = some.join(cells.hint("merge"), ["fold", "donor_geo"]).withColumn("base", F.col("apart") + F.pow((F.col("position") - F.col("donor_position")) / F.col("stage_scale"), 2)).where("base <= reach")
    within = met.select(*cell, "chunks", "donor_geo", "donor_lag", "base").join(own.drop("donor_position").hint("merge"), ["fold", "donor_geo", "donor_lag"])
    rest = bounds.where("position IS NULL OR u = double('infinity')").join(own.hint("merge"), "fold").join(pairs.hint("merge"), ["fold", "geo_value", "donor_geo"], "left")
    base = F.when(F.col("position").isNotNull() & F.col("donor_position").isNotNull(), F.coalesce(F.pow(F.col("distance") / F.col("curve_scale"), 2), F.lit(0.0)) + F.pow((F.col("position") - F.col("donor_position")) / F.col("stage_scale"), 2))
    rest = rest.select(*cell, "chunks", "donor_geo", "donor_lag", base.alias("base"), "remaining", "state")
    given = within.select(rest.columns).unionByName(rest).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    given = given.select(*cell, "chunk", F.xxhash64("donor_geo").alias("place"), F.col("donor_lag").alias("d_lag"), "base", "remaining", F.col("state").alias("d_state"))
    chunked = cases.join(bounds.select(*cell, "chunks").hint("merge"), cell).join(F.broadcast(mad), "fold")
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("reference_date", "report_date"), F.col("chunks")).cast("int")).drop("chunks", "position")

    def weigh(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine):
            return pa.table({n: pa.array([], t) for n, t in kinds})
        order = theirs.sort_by("remaining") if len(theirs) else theirs
        numbers = lambda t, c: t[c].cast(pa.float64()).to_numpy(zero_copy_only=False) if t[c].null_count == 0 else np.array(t[c].cast(pa.float64()).fill_null(math.nan).to_numpy())
        d = {"base": numbers(order, "base"), "state": numbers(order, "d_state"), "lag": numbers(order, "d_lag"), "remaining": numbers(order, "remaining"), "place": order["place"].to_numpy()}
        c = {"state": numbers(mine, "state"), "lag": numbers(mine, "lag"), "curve": mine["curve"].to_pylist()}
        found = _weigh(c, d, mine["scale"][0].as_py())
        return pa.table([mine[n] if n in mine.column_names else pa.array(found[n], t) for n, t in kinds], names=[n for n, _ in kinds])

    of = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "date": pa.date32()}
    kinds = [(n, of[t]) for n, t in (c.split() for c in _MATCH.split(", "))]
    keys = [*cell, "chunk"]
    return chunked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(weigh, _MATCH)


_PART = "PARTITION BY fold, geo_value, reference_date, report_date"
frame_model("donor_matches", ("attach_progress", "location_curves", "curve_pairs", "curve_scale", "stage_scale", "donors", "mad_scale"), match, public=False, sql=f"""
    WITH c AS (SELECT fold, geo_value, reference_date, report_date, lag, truth, latest, progress AS state FROM {{attach_progress}}),
    p AS (
      SELECT c.*, d.remaining, t.base + CASE WHEN c.state IS NULL THEN 0e0 ELSE ((c.state - d.state) / m.scale) * ((c.state - d.state) / m.scale) END AS d2
      FROM c JOIN {{task_cells}} t ON t.fold = c.fold AND t.geo_value = c.geo_value AND t.lag = c.lag
      JOIN {{donors}} d ON d.fold = t.fold AND d.geo_value = t.donor_geo AND d.lag = t.donor_lag JOIN {{mad_scale}} m ON m.fold = c.fold
      WHERE c.state IS NULL OR d.state IS NOT NULL
      UNION ALL
      SELECT c.*, d.remaining, (c.lag - d.lag) * (c.lag - d.lag) / {LAST * LAST}e0 + CASE WHEN c.state IS NULL THEN 0e0 ELSE ((c.state - d.state) / m.scale) * ((c.state - d.state) / m.scale) END
      FROM c ANTI JOIN {{location_curves}} t ON t.fold = c.fold AND t.geo_value = c.geo_value AND t.lag = c.lag
      JOIN {{donors}} d ON d.fold = c.fold JOIN {{mad_scale}} m ON m.fold = c.fold WHERE c.state IS NULL OR d.state IS NOT NULL),
    w AS (SELECT *, exp({GAMMA} * ((min(d2) OVER ({_PART})) - d2)) AS w FROM p),
    s AS (SELECT *, sum(w) OVER ({_PART}) AS total, sum(w) OVER ({_PART} ORDER BY remaining RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulated FROM w)
    SELECT fold, geo_value, reference_date, report_date, lag, truth, latest, sum(w) * sum(w) / sum(w * w) AS effective_donors, max(w) / sum(w) AS largest_weight, sum(w * remaining) / sum(w) AS mean_remaining,
           {', '.join(f'min(CASE WHEN cumulated >= {t} * total - 1e-9 * total THEN remaining END) AS {q}' for t, q in zip(TAUS, QS))}
    FROM s GROUP BY fold, geo_value, reference_date, report_date, lag, truth, latest
""")
_KEY = "fold, geo_value, reference_date, report_date, lag"
model("donor_weights", f"""
    SELECT {_KEY}, effective_donors, largest_weight, mean_remaining FROM {{donor_matches}}
""")
model("weighted_quantiles", f"""
    SELECT {_KEY}, truth, latest, {', '.join(QS)} FROM {{donor_matches}}
""")
# who was weighed: cases by fallback, and how many donors and locations were within reach
frame_model("donor_support", ("donor_matches",), lambda m: m.groupBy("fold", "lag", "fallback").agg(F.count(F.lit(1)).alias("cases"), F.avg("donors").alias("donors"), F.avg("donor_locations").alias("donor_locations")))
model("donor_forecast", f"""
    SELECT fold, geo_value, reference_date, report_date, lag, latest + q0_5 AS prediction, abs(truth - latest - q0_5) AS absolute_error, {', '.join(f'latest + {q} AS {q}' for q in QS)} FROM {{weighted_quantiles}}
""")
model("routing_audit_by_lag", """
    WITH u AS (SELECT lag, 'effective_donors' AS field, effective_donors AS x FROM {donor_weights} UNION ALL SELECT lag, 'largest_weight', largest_weight FROM {donor_weights})
    SELECT lag, field, CAST(count(*) AS BIGINT) AS n, avg(x) AS mean, {pct(x; 5e-1)} AS median FROM u GROUP BY lag, field
""")
