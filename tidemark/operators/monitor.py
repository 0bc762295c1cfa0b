"""The reporting process by day, its state, and how far the state has shifted from its own past."""

from ..models import model

model("process_daily", """
    WITH d AS (
      SELECT geo_value, report_date, CAST(count(*) AS DOUBLE) AS volume, CAST(count(DISTINCT reference_date) AS DOUBLE) AS reference_dates,
             avg(CASE WHEN value <> before THEN 1e0 ELSE 0e0 END) AS genuine_share,
             avg(CASE WHEN abs(value - before) <= 1e-12 THEN 1e0 ELSE 0e0 END) AS zero_share,
             avg(ln(1 + value) - ln(1 + before)) AS mean_change, avg(abs(ln(1 + value) - ln(1 + before))) AS mean_abs_change
      FROM {validity_a} GROUP BY geo_value, report_date),
    g AS (SELECT *, {days(report_date; lag(report_date) OVER (PARTITION BY geo_value ORDER BY report_date))} AS gap FROM d)
    SELECT geo_value, report_date, volume, reference_dates, genuine_share, zero_share, mean_change, mean_abs_change,
           coalesce(CAST(gap AS DOUBLE), 1e0) AS gap_days, CASE WHEN gap > 1 THEN 1e0 ELSE 0e0 END AS gap_flag
    FROM g
""")
model("process_long", """
    SELECT geo_value, report_date, 'volume' AS coordinate, volume AS x FROM {process_daily}
    UNION ALL SELECT geo_value, report_date, 'reference_dates', reference_dates FROM {process_daily}
    UNION ALL SELECT geo_value, report_date, 'genuine_share', genuine_share FROM {process_daily}
    UNION ALL SELECT geo_value, report_date, 'zero_share', zero_share FROM {process_daily}
    UNION ALL SELECT geo_value, report_date, 'mean_change', mean_change FROM {process_daily}
    UNION ALL SELECT geo_value, report_date, 'mean_abs_change', mean_abs_change FROM {process_daily}
    UNION ALL SELECT geo_value, report_date, 'gap_days', gap_days FROM {process_daily}
""", public=False)
model("process_states", """
    WITH w AS (
      SELECT geo_value, report_date, coordinate,
             avg(x) OVER (PARTITION BY geo_value, coordinate ORDER BY {days(report_date; DATE '1970-01-01')} RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS m,
             count(x) OVER (PARTITION BY geo_value, coordinate ORDER BY {days(report_date; DATE '1970-01-01')} RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS n
      FROM {process_long})
    SELECT geo_value, report_date, coordinate, CASE WHEN n >= 4 THEN round(m, 9) END AS state FROM w
""")
# states of the 84 days before each origin's last 28
model("process_history", """
    SELECT /*+ BROADCAST(s) */ s.fold, s.cutoff, p.geo_value, p.coordinate, p.report_date, p.state
    FROM {process_states} p JOIN {schedule} s ON p.report_date < s.cutoff AND p.report_date >= {plus(s.cutoff; 0 - 112)}
    WHERE p.state IS NOT NULL
""", public=False)
model("historical_scale", """
    WITH m AS (
      SELECT fold, cutoff, geo_value, coordinate, {pct(state; 5e-1)} AS center, {pct(abs(state); 5e-1)} AS size, {pct(state; 75e-2)} - {pct(state; 25e-2)} AS iqr,
             stddev_samp(state) AS sd, CAST(count(*) AS BIGINT) AS n
      FROM {process_history} GROUP BY fold, cutoff, geo_value, coordinate),
    a AS (
      SELECT h.fold, h.geo_value, h.coordinate, {pct(abs(h.state - m.center); 5e-1)} AS mad
      FROM {process_history} h JOIN m ON m.fold = h.fold AND m.geo_value = h.geo_value AND m.coordinate = h.coordinate
      GROUP BY h.fold, h.geo_value, h.coordinate)
    SELECT m.fold, m.cutoff, m.geo_value, m.coordinate, m.n, m.center,
           CASE WHEN 14826e-4 * mad > 1e-7 * size + 1e-9 THEN 14826e-4 * mad WHEN iqr / 1349e-3 > 1e-7 * size + 1e-9 THEN iqr / 1349e-3
                WHEN sd > 1e-7 * size + 1e-9 THEN sd END AS scale
    FROM m JOIN a ON a.fold = m.fold AND a.geo_value = m.geo_value AND a.coordinate = m.coordinate
""")
model("process_scores", """
    WITH now AS (
      SELECT /*+ BROADCAST(s) */ s.fold, p.geo_value, p.coordinate, max_by(p.state, p.report_date) AS state
      FROM {process_states} p JOIN {schedule} s ON p.report_date <= s.cutoff AND p.report_date > {plus(s.cutoff; 0 - 28)}
      WHERE p.state IS NOT NULL GROUP BY s.fold, p.geo_value, p.coordinate)
    SELECT h.fold, h.cutoff, h.geo_value, h.coordinate, h.n, round(abs(now.state - h.center) / h.scale, 6) AS score
    FROM {historical_scale} h JOIN now ON now.fold = h.fold AND now.geo_value = h.geo_value AND now.coordinate = h.coordinate
    WHERE h.n >= 8 AND h.scale IS NOT NULL
""", public=False)
model("process_shift", """
    WITH b AS (SELECT fold, cutoff, geo_value, max(score) AS top, CAST(count(*) AS BIGINT) AS coordinates FROM {process_scores} GROUP BY fold, cutoff, geo_value),
    d AS (
      SELECT s.fold, s.geo_value, min(s.coordinate) AS driver FROM {process_scores} s
      JOIN b ON b.fold = s.fold AND b.geo_value = s.geo_value AND b.top = s.score GROUP BY s.fold, s.geo_value),
    g AS (SELECT fold, cutoff, geo_value FROM {schedule} CROSS JOIN (SELECT DISTINCT geo_value FROM {archive_a}) x)
    SELECT g.fold, g.cutoff, g.geo_value, b.top AS process_shift_score, d.driver AS process_shift_driver, coalesce(b.coordinates, 0) AS coordinates,
           CASE WHEN b.top IS NULL THEN 'insufficient-history' WHEN b.top < 3 THEN 'stable' WHEN b.top < 5 THEN 'watch' ELSE 're-diagnose' END AS process_state
    FROM g LEFT JOIN b ON b.fold = g.fold AND b.geo_value = g.geo_value LEFT JOIN d ON d.fold = g.fold AND d.geo_value = g.geo_value
""")
