"""Similarity routes between locations, and pools of (location, lag) tasks."""

from ..models import frame_model, model
from . import draws, episodes, search  # noqa: F401

BANDS = "CASE WHEN lag <= 7 THEN 1 WHEN lag <= 14 THEN 2 WHEN lag <= 28 THEN 3 ELSE 4 END"
METRICS = ("spacing", "genuine_rate", "median_revision", "median_abs_revision", "mad_revision")

model("profile_rows", f"""
    SELECT /*+ BROADCAST(s) */ s.fold, v.geo_value, {BANDS} AS band, v.revision, v.gap
    FROM (SELECT geo_value, report_date, lag, ln(1 + value) - ln(1 + before) AS revision, lag - (lag(lag) OVER (PARTITION BY geo_value, reference_date ORDER BY lag)) AS gap FROM {{validity_a}}) v
    JOIN {{schedule}} s ON v.report_date <= s.cutoff AND v.report_date > {{plus(s.cutoff; 0 - s.training_days)}}
""", public=False)
model("process_profiles", """
    WITH c AS (SELECT fold, geo_value, band, {pct(revision; 5e-1)} AS center FROM {profile_rows} GROUP BY fold, geo_value, band)
    SELECT p.fold, p.geo_value, p.band, {pct(p.gap; 5e-1)} AS spacing, avg(CASE WHEN abs(p.revision) > 149e-10 THEN 1e0 ELSE 0e0 END) AS genuine_rate, {pct(p.revision; 5e-1)} AS median_revision,
           {pct(abs(p.revision); 5e-1)} AS median_abs_revision, {pct(abs(p.revision - c.center); 5e-1)} AS mad_revision, CAST(count(*) AS BIGINT) AS n
    FROM {profile_rows} p JOIN c ON c.fold = p.fold AND c.geo_value = p.geo_value AND c.band = p.band GROUP BY p.fold, p.geo_value, p.band
""")
model("profile_standardize", f"""
    WITH u AS ({' UNION ALL '.join(f"SELECT fold, geo_value, band, '{m}' AS metric, CAST({m} AS DOUBLE) AS x FROM {{process_profiles}}" for m in METRICS)}),
    c AS (SELECT fold, band, metric, {{pct(x; 5e-1)}} AS center FROM u GROUP BY fold, band, metric),
    s AS (SELECT u.fold, u.band, u.metric, {{pct(abs(u.x - c.center); 5e-1)}} AS mad, max(c.center) AS center FROM u JOIN c ON c.fold = u.fold AND c.band = u.band AND c.metric = u.metric GROUP BY u.fold, u.band, u.metric)
    SELECT u.fold, u.geo_value, u.band, u.metric, (coalesce(u.x, s.center) - s.center) / CASE WHEN s.mad > 1e-12 THEN s.mad ELSE 1e0 END AS z
    FROM u JOIN s ON s.fold = u.fold AND s.band = u.band AND s.metric = u.metric
""")
model("similarity_routes", """
    WITH d AS (
      SELECT a.fold, a.band, a.geo_value AS target, b.geo_value AS source, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS distance
      FROM {profile_standardize} a JOIN {profile_standardize} b ON b.fold = a.fold AND b.band = a.band AND b.metric = a.metric GROUP BY a.fold, a.band, a.geo_value, b.geo_value),
    h AS (SELECT fold, band, CASE WHEN {pct(distance; 5e-1)} > 0 THEN {pct(distance; 5e-1)} ELSE 1e0 END AS bandwidth FROM d WHERE target < source GROUP BY fold, band),
    k AS (SELECT d.*, exp(0e0 - d.distance * d.distance / (2 * h.bandwidth * h.bandwidth)) AS kernel FROM d JOIN h ON h.fold = d.fold AND h.band = d.band)
    SELECT fold, band, target, source, distance, kernel / sum(kernel) OVER (PARTITION BY fold, band, target) AS weight FROM k
""")
model("route_weights", f"""
    WITH t AS (SELECT fold, geo_value, reference_date, lag, {BANDS} AS band FROM {{completed_training}} WHERE strict),
    g AS (SELECT DISTINCT fold, geo_value AS target FROM t),
    w AS (
      SELECT t.*, g.target, coalesce(r.weight, CASE WHEN t.geo_value = g.target THEN 1e0 ELSE 0e0 END) AS weight
      FROM t JOIN g ON g.fold = t.fold LEFT JOIN {{similarity_routes}} r ON r.fold = t.fold AND r.band = t.band AND r.target = g.target AND r.source = t.geo_value),
    m AS (SELECT fold, target, avg(CASE WHEN weight > 0 THEN weight END) AS mean FROM w GROUP BY fold, target)
    SELECT w.fold, w.target, w.geo_value, w.reference_date, w.lag, w.weight / m.mean AS weight FROM w JOIN m ON m.fold = w.fold AND m.target = w.target
""")
# as many draws for each target and lag group as it has rows; for the oracle draws and rows are put in one order by target
frame_model("weighted_resample", ("route_weights", "lag_groups"), draws.resample, sql="""
    WITH r AS (
      SELECT fold, lag_group, target, geo_value, reference_date, lag, CAST(round(weight * 1e6) AS BIGINT) AS weight, row_number() OVER w AS place,
             CAST(sum(CAST(round(weight * 1e6) AS BIGINT)) OVER w AS BIGINT) AS upto
      FROM {route_weights} JOIN {lag_groups} ON lag BETWEEN lo - 1 AND hi + 1
      WINDOW w AS (PARTITION BY fold, lag_group, target ORDER BY geo_value, reference_date, lag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    t AS (SELECT fold, lag_group, target, CAST(max(upto) AS BIGINT) AS total FROM r GROUP BY fold, lag_group, target),
    u AS (
      SELECT fold, lag_group, target, upto - weight AS spot, CAST(NULL AS BIGINT) AS draw, geo_value, reference_date, lag FROM r WHERE weight > 0
      UNION ALL
      SELECT r.fold, r.lag_group, r.target, {hex48(concat('resample:', CAST(r.fold AS STRING), ':', r.lag_group, ':', r.target, ':', CAST(r.place AS STRING)))} % t.total, CAST(r.place AS BIGINT), NULL, NULL, NULL
      FROM r JOIN t ON t.fold = r.fold AND t.lag_group = r.lag_group AND t.target = r.target WHERE t.total > 0),
    s AS (
      SELECT fold, lag_group, target, draw, {last(geo_value)} OVER w AS geo_value, {last(reference_date)} OVER w AS reference_date, {last(lag)} OVER w AS lag
      FROM u WINDOW w AS (PARTITION BY fold, lag_group, target ORDER BY spot, CASE WHEN draw IS NULL THEN 0 ELSE 1 END, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT fold, lag_group, target, draw, geo_value, reference_date, lag FROM s WHERE draw IS NOT NULL
""")
model("train_sets_similarity", """
    SELECT fold, target, draw, geo_value, reference_date, lag, lag_group FROM {weighted_resample}
""")
# A task is a (location, lag) of an origin: what is usual in the rest of an episode from there on (episodes.py), its course,
# and how far it is from the target. Every episode is summarized once; an origin takes those completed before it.
# Medians of numbers of 9 digits have 10: to these they are rounded, so that no rounding falls on a half.
model("task_rows", """
    SELECT /*+ BROADCAST(s) */ s.fold, e.geo_value, e.reference_date, e.lag, e.median_gap, e.zero_share, e.median_step, e.median_abs_step, e.mad_step, t.latest, t.target
    FROM {episode_summaries} e JOIN {schedule} s ON e.target_date <= s.cutoff AND e.target_date > {plus(s.cutoff; 0 - s.training_days)}
    JOIN {completed_training} t ON t.fold = s.fold AND t.geo_value = e.geo_value AND t.reference_date = e.reference_date AND t.lag = e.lag AND t.genuine
""", public=False)
_PROFILE = ("median_gap", "zero_share", "median_step", "median_abs_step", "mad_step")
model("task_profiles", f"""
    SELECT fold, geo_value, lag, {', '.join(f'round({{pct({c}; 5e-1)}}, 10) AS {c}' for c in _PROFILE)}, round({{pct(abs(target - latest); 5e-1)}}, 10) AS stage, CAST(count(*) AS BIGINT) AS n
    FROM {{task_rows}} GROUP BY fold, geo_value, lag
""", public=False)
model("task_prototypes", f"""
    WITH c AS (SELECT fold, {', '.join(f'{{pct({c}; 5e-1)}} AS {c}' for c in _PROFILE)} FROM {{task_profiles}} GROUP BY fold),
    s AS (SELECT p.fold, {', '.join(f'max(c.{c}) AS c_{c}, {{pct(abs(p.{c} - c.{c}); 5e-1)}} AS m_{c}' for c in _PROFILE)} FROM {{task_profiles}} p JOIN c ON c.fold = p.fold GROUP BY p.fold)
    SELECT p.fold, p.geo_value, p.lag, p.stage, p.n, {', '.join(f'round((p.{c} - s.c_{c}) / CASE WHEN s.m_{c} > 0 THEN s.m_{c} ELSE 1e0 END, 9) AS {c}' for c in _PROFILE)}
    FROM {{task_profiles}} p JOIN s ON s.fold = p.fold
""")
model("task_courses", """
    SELECT r.fold, r.geo_value, r.lag, e.from_lag, round({pct(e.step; 5e-1)}, 10) AS step
    FROM {task_rows} r JOIN {episode_steps} e ON e.geo_value = r.geo_value AND e.reference_date = r.reference_date AND e.from_lag >= r.lag
    GROUP BY r.fold, r.geo_value, r.lag, e.from_lag
""", public=False)
model("structural_edges", """
    WITH n AS (SELECT fold, geo_value, lag, lead(lag) OVER (PARTITION BY fold, geo_value ORDER BY lag) AS next_lag FROM {task_prototypes})
    SELECT a.fold, a.geo_value AS a_geo, a.lag AS a_lag, b.geo_value AS b_geo, b.lag AS b_lag FROM n a JOIN n b ON b.fold = a.fold AND b.lag = a.lag AND a.geo_value < b.geo_value
    UNION ALL SELECT fold, geo_value, lag, geo_value, next_lag FROM n WHERE next_lag IS NOT NULL
""")
frame_model("task_vectors", ("task_prototypes", "task_courses"), search.vectors, public=False, digits=None)
# Distances are worked out for the pairs that the searches ask for (search.py). What follows says the same of all pairs of
# an origin at once, for the oracle.
model("dense_components", f"""
    WITH p AS (
      SELECT a.fold, a.geo_value AS a_geo, a.lag AS a_lag, b.geo_value AS b_geo, b.lag AS b_lag, round(abs(a.stage - b.stage), 10) AS d_stage,
             round(sqrt({' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in _PROFILE)}), 9) AS d_profile
      FROM {{task_prototypes}} a JOIN {{task_prototypes}} b ON b.fold = a.fold AND (a.geo_value < b.geo_value OR a.geo_value = b.geo_value AND a.lag < b.lag)),
    c AS (
      SELECT p.fold, p.a_geo, p.a_lag, p.b_geo, p.b_lag, round(sqrt(avg((x.step - y.step) * (x.step - y.step))), 10) AS d_course
      FROM p JOIN {{task_courses}} x ON x.fold = p.fold AND x.geo_value = p.a_geo AND x.lag = p.a_lag
      JOIN {{task_courses}} y ON y.fold = p.fold AND y.geo_value = p.b_geo AND y.lag = p.b_lag AND y.from_lag - p.b_lag = x.from_lag - p.a_lag
      GROUP BY p.fold, p.a_geo, p.a_lag, p.b_geo, p.b_lag)
    SELECT p.*, c.d_course FROM p JOIN c ON c.fold = p.fold AND c.a_geo = p.a_geo AND c.a_lag = p.a_lag AND c.b_geo = p.b_geo AND c.b_lag = p.b_lag
""", public=False)
_EDGE = "e.fold = c.fold AND e.a_geo = c.a_geo AND e.a_lag = c.a_lag AND e.b_geo = c.b_geo AND e.b_lag = c.b_lag"
_DISTANCE = "round(sqrt((c.d_profile / s.d_profile) * (c.d_profile / s.d_profile) + (c.d_course / s.d_course) * (c.d_course / s.d_course) + (c.d_stage / s.d_stage) * (c.d_stage / s.d_stage)), 6)"
frame_model("edge_components", ("task_vectors", "structural_edges"), search.components, public=False, sql=f"SELECT c.* FROM {{dense_components}} c JOIN {{structural_edges}} e ON {_EDGE}")
model("sparse_scales", f"""
    SELECT fold, {', '.join(f"coalesce({{pct(CASE WHEN {d} > 0 THEN {d} END; 5e-1)}}, 1e0) AS {d}" for d in ('d_profile', 'd_course', 'd_stage'))}
    FROM {{edge_components}} GROUP BY fold
""")
model("edge_distance", f"""
    SELECT c.fold, c.a_geo, c.a_lag, c.b_geo, c.b_lag, {_DISTANCE} AS distance FROM {{edge_components}} c JOIN {{sparse_scales}} s ON s.fold = c.fold
""", public=False)
model("dense_distance", f"""
    WITH d AS (SELECT c.fold, c.a_geo, c.a_lag, c.b_geo, c.b_lag, {_DISTANCE} AS distance FROM {{dense_components}} c JOIN {{sparse_scales}} s ON s.fold = c.fold)
    SELECT fold, a_geo AS geo_value, a_lag AS lag, b_geo AS other_geo, b_lag AS other_lag, distance FROM d UNION ALL SELECT fold, b_geo, b_lag, a_geo, a_lag, distance FROM d
""", public=False)
model("nearest_threshold", """
    WITH b AS (SELECT fold, a_geo AS geo_value, a_lag AS lag, distance FROM {edge_distance} UNION ALL SELECT fold, b_geo, b_lag, distance FROM {edge_distance}),
    n AS (SELECT fold, geo_value, lag, min(distance) AS nearest FROM b GROUP BY fold, geo_value, lag)
    SELECT fold, round({pct(nearest; 75e-2)} + 15e-1 * ({pct(nearest; 75e-2)} - {pct(nearest; 25e-2)}), 6) AS threshold, CAST(count(*) AS BIGINT) AS tasks FROM n GROUP BY fold
""")
frame_model("walked", ("task_vectors", "sparse_scales", "nearest_threshold"), search.walk, public=False)
frame_model("same_location_search", ("walked",), lambda w: w.where("geo_value = other_geo").drop("other_geo"), sql="""
    WITH d AS (
      SELECT b.*, b.distance > t.threshold AS miss, CASE WHEN b.other_lag > b.lag THEN 1 ELSE -1 END AS direction, abs(b.other_lag - b.lag) AS step
      FROM {dense_distance} b JOIN {nearest_threshold} t ON t.fold = b.fold WHERE b.geo_value = b.other_geo),
    m AS (SELECT *, CASE WHEN miss AND (lag(miss) OVER w) THEN 1 ELSE 0 END AS stops FROM d WINDOW w AS (PARTITION BY fold, geo_value, lag, direction ORDER BY step)),
    s AS (SELECT *, coalesce(sum(stops) OVER (PARTITION BY fold, geo_value, lag, direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM m)
    SELECT fold, geo_value, lag, other_lag, distance FROM s WHERE stopped = 0
""")
# a location without the anchor's lag has no center: its lags on each side are walked from the nearest on
frame_model("cross_location_search", ("walked",), lambda w: w.where("geo_value <> other_geo"), sql="""
    WITH d AS (
      SELECT b.*, t.threshold, CASE WHEN b.other_lag > b.lag THEN 1 ELSE -1 END AS direction, abs(b.other_lag - b.lag) AS step, c.distance AS center
      FROM {dense_distance} b JOIN {nearest_threshold} t ON t.fold = b.fold
      LEFT JOIN {dense_distance} c ON c.fold = b.fold AND c.geo_value = b.geo_value AND c.lag = b.lag AND c.other_geo = b.other_geo AND c.other_lag = b.lag
      WHERE b.geo_value <> b.other_geo AND b.other_lag <> b.lag),
    r AS (
      SELECT *, row_number() OVER w AS place, distance > threshold AS miss,
             least(coalesce(center, 1e300), coalesce(min(distance) OVER (PARTITION BY fold, geo_value, lag, other_geo, direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300)) AS best FROM d
      WINDOW w AS (PARTITION BY fold, geo_value, lag, other_geo, direction ORDER BY step)),
    p AS (
      SELECT *, CASE WHEN place = 1 AND center IS NOT NULL AND distance >= center THEN 1 WHEN miss AND distance >= best AND (lag(miss) OVER (PARTITION BY fold, geo_value, lag, other_geo, direction ORDER BY step)) THEN 1 ELSE 0 END AS stops FROM r),
    s AS (SELECT *, coalesce(sum(stops) OVER (PARTITION BY fold, geo_value, lag, other_geo, direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM p)
    SELECT fold, geo_value, lag, other_geo, other_lag, distance FROM s WHERE stopped = 0
    UNION ALL SELECT fold, geo_value, lag, other_geo, other_lag, distance FROM {dense_distance} WHERE geo_value <> other_geo AND other_lag = lag
""")
# every pair that was asked for, once
model("task_distance", """
    WITH q AS (
      SELECT fold, geo_value AS a_geo, lag AS a_lag, geo_value AS b_geo, other_lag AS b_lag, distance FROM {same_location_search}
      UNION ALL SELECT fold, geo_value, lag, other_geo, other_lag, distance FROM {cross_location_search}),
    o AS (
      SELECT fold, a_geo, a_lag, b_geo, b_lag, distance FROM q WHERE a_geo < b_geo OR a_geo = b_geo AND a_lag < b_lag
      UNION ALL SELECT fold, b_geo, b_lag, a_geo, a_lag, distance FROM q WHERE NOT (a_geo < b_geo OR a_geo = b_geo AND a_lag < b_lag))
    SELECT fold, a_geo, a_lag, b_geo, b_lag, min(distance) AS distance FROM o GROUP BY fold, a_geo, a_lag, b_geo, b_lag
""")
model("unseen_task_fallback", """
    WITH k AS (SELECT DISTINCT fold, geo_value, lag FROM {build_cases}),
    u AS (SELECT k.* FROM k LEFT JOIN {task_prototypes} t ON t.fold = k.fold AND t.geo_value = k.geo_value AND t.lag = k.lag WHERE t.lag IS NULL),
    r AS (
      SELECT u.fold, u.geo_value, u.lag, t.geo_value AS task_geo, t.lag AS task_lag,
             row_number() OVER (PARTITION BY u.fold, u.geo_value, u.lag ORDER BY CASE WHEN t.geo_value = u.geo_value THEN 0 ELSE 1 END, abs(t.lag - u.lag), t.lag, t.geo_value) AS place
      FROM u JOIN {task_prototypes} t ON t.fold = u.fold)
    SELECT fold, geo_value, lag, task_geo, task_lag FROM r WHERE place = 1
""")
