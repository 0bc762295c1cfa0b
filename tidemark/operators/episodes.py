"""What the rest of a completed episode holds, from each of its releases on: five numbers, and a course by a natural spline.

An episode's releases before lag LAST and its target at LAST are its knots. They are a short list, so a task takes many
episodes at once and solves a tridiagonal system for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model

LAST = 28


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y), x ascending, at places; beyond the knots the end pieces go on. Two knots: the line,
    level beyond them."""
    n = len(x)
    if n == 2:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    # second derivatives m, none at the ends: h[i-1] m[i-1] + 2 (h[i-1] + h[i]) m[i] + h[i] m[i+1] = 6 (slope[i] - slope[i-1])
    c, d = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        w = 2 * (h[i - 1] + h[i]) - h[i - 1] * c[i - 1]
        c[i], d[i] = h[i] / w, (6 * (slope[i] - slope[i - 1]) - h[i - 1] * d[i - 1]) / w
    m = np.zeros(n)
    for i in range(n - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, hk = at - x[k], h[k]
    return y[k] + t * (slope[k] - hk * (2 * m[k] + m[k + 1]) / 6) + t * t * m[k] / 2 + t * t * t * (m[k + 1] - m[k]) / (6 * hk)


def steps(knots: DataFrame) -> DataFrame:
    """geo_value, reference_date, from_lag, step: what the spline through an episode's knots gains from a lag to the next."""
    episodes = knots.groupBy("geo_value", "reference_date").agg(F.sort_array(F.collect_list(F.struct("lag", "y"))).alias("k")).where(F.size("k") >= 2)
    grid = np.arange(LAST + 1, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lags, values = b["lags"].to_pylist(), b["values"].to_pylist()
            made = [np.round(np.diff(natural_spline(np.array(x, float), np.array(y, float), grid)), 9) + 0.0 for x, y in zip(lags, values)]
            ends = pa.array(np.arange(len(b) + 1) * LAST, pa.int32())
            flat = pa.array(np.concatenate(made) if made else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b["geo_value"], b["reference_date"], pa.ListArray.from_arrays(ends, flat)], ["geo_value", "reference_date", "steps"])

    packed = episodes.select("geo_value", "reference_date", F.col("k.lag").alias("lags"), F.col("k.y").alias("values"))
    made = packed.mapInArrow(run, "geo_value string, reference_date date, steps array<double>")
    return made.select("geo_value", "reference_date", F.posexplode("steps").alias("from_lag", "step"))


model("episode_knots", f"""
    SELECT t.geo_value, t.reference_date, t.lag, t.log_value_7dav AS y FROM {{triangle}} t WHERE t.lag < {LAST} AND t.target_date IS NOT NULL AND t.log_value_7dav IS NOT NULL
    UNION ALL SELECT geo_value, reference_date, {LAST}, ln(1 + target_value) FROM {{delayed_target}}
""", public=False)
# the same by recursive queries along each episode's knots, for the oracle
frame_model("episode_steps", ("episode_knots",), steps, public=False, sql=f"""
    WITH RECURSIVE k AS (
      SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY geo_value, reference_date) AS n, (lead(lag) OVER w) - lag AS h, ((lead(y) OVER w) - y) / ((lead(lag) OVER w) - lag) AS slope,
             lag - (lag(lag) OVER w) AS hp, (y - (lag(y) OVER w)) / (lag - (lag(lag) OVER w)) AS slope_p
      FROM {{episode_knots}} WINDOW w AS (PARTITION BY geo_value, reference_date ORDER BY lag)),
    f AS (
      SELECT geo_value, reference_date, i, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d FROM k WHERE i = 1 AND n >= 2
      UNION ALL
      SELECT k.geo_value, k.reference_date, k.i, k.h / (2 * (k.hp + k.h) - k.hp * f.c), (6 * (k.slope - k.slope_p) - k.hp * f.d) / (2 * (k.hp + k.h) - k.hp * f.c)
      FROM f JOIN k ON k.geo_value = f.geo_value AND k.reference_date = f.reference_date AND k.i = f.i + 1 AND k.i < k.n),
    m AS (
      SELECT geo_value, reference_date, i, CAST(0 AS DOUBLE) AS m FROM k WHERE i = n AND n >= 2
      UNION ALL
      SELECT f.geo_value, f.reference_date, f.i, CASE WHEN f.i = 1 THEN 0 ELSE f.d - f.c * m.m END FROM m JOIN f ON f.geo_value = m.geo_value AND f.reference_date = m.reference_date AND f.i = m.i - 1),
    p AS (
      SELECT k.*, coalesce(m.m, 0) AS m0, coalesce(lead(m.m) OVER (PARTITION BY k.geo_value, k.reference_date ORDER BY k.i), 0) AS m1
      FROM k JOIN m ON m.geo_value = k.geo_value AND m.reference_date = k.reference_date AND m.i = k.i),
    g AS (
      SELECT p.geo_value, p.reference_date, x.from_lag, CASE WHEN p.n = 2 AND x.from_lag < p.lag THEN p.y ELSE p.y + (x.from_lag - p.lag) * (p.slope - p.h * (2 * p.m0 + p.m1) / 6) + (x.from_lag - p.lag) * (x.from_lag - p.lag) * p.m0 / 2
                    + (x.from_lag - p.lag) * (x.from_lag - p.lag) * (x.from_lag - p.lag) * (p.m1 - p.m0) / (6 * p.h) END AS y
      FROM p JOIN (SELECT CAST(unnest(range(0, {LAST} + 1)) AS INTEGER) AS from_lag) x ON p.i < p.n AND (x.from_lag >= p.lag OR p.i = 1) AND (x.from_lag < p.lag + p.h OR p.i = p.n - 1))
    SELECT geo_value, reference_date, from_lag, step FROM (
      SELECT geo_value, reference_date, from_lag, round((lead(y) OVER (PARTITION BY geo_value, reference_date ORDER BY from_lag)) - y, 9) + 0 AS step FROM g) t WHERE step IS NOT NULL
""")
# from each release on: the median gap of the releases that follow, and of their changes the share of none, the median, and the medians of sizes
model("episode_summaries", f"""
    WITH d AS (
      SELECT geo_value, reference_date, lag, (lead(lag) OVER w) - lag AS gap, (lead(y) OVER w) - y AS step
      FROM {{episode_knots}} WINDOW w AS (PARTITION BY geo_value, reference_date ORDER BY lag)),
    r AS (
      SELECT a.geo_value, a.reference_date, a.lag, b.gap, b.step FROM d a JOIN d b ON b.geo_value = a.geo_value AND b.reference_date = a.reference_date AND b.lag >= a.lag
      WHERE a.gap IS NOT NULL AND b.gap IS NOT NULL),
    c AS (SELECT geo_value, reference_date, lag, {{pct(step; 5e-1)}} AS center FROM r GROUP BY geo_value, reference_date, lag)
    SELECT r.geo_value, r.reference_date, {{plus(r.reference_date; {LAST})}} AS target_date, r.lag, CAST(count(*) AS BIGINT) AS releases, {{pct(r.gap; 5e-1)}} AS median_gap,
           avg(CASE WHEN r.step = 0 THEN 1e0 ELSE 0e0 END) AS zero_share, round(max(c.center), 9) AS median_step, round({{pct(abs(r.step); 5e-1)}}, 9) AS median_abs_step,
           round({{pct(abs(r.step - c.center); 5e-1)}}, 9) AS mad_step
    FROM r JOIN c ON c.geo_value = r.geo_value AND c.reference_date = r.reference_date AND c.lag = r.lag GROUP BY r.geo_value, r.reference_date, r.lag
""".replace(f"{{plus(r.reference_date; {LAST})}}", "{plus(r.reference_date; 28)}"))
model("episode_course", """
    SELECT geo_value, reference_date, from_lag, step FROM {episode_steps}
""")
