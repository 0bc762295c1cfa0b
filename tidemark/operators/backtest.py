"""Rolling origins, the cases each must forecast and the rows it may learn from."""

from ..models import model

# Origins at every retraining interval from the first, FIRST_ORIGIN days after the first report unless the settings name
# a date, to the last report. An origin's window is the interval itself, so windows adjoin and every later report is in one.
# asked_backtest: what a user asks for in place of what the archive's resolution suggests; null is not asked for.
model("asked_backtest", """
    SELECT CAST(200 AS INT) AS retraining_days, CAST(360 AS INT) AS training_days, CAST(28 AS INT) AS target_lag, CAST(NULL AS DATE) AS first_origin
""", public=False)
model("archive_span", """
    WITH b AS (
      SELECT min(report_date) AS lo, max(report_date) AS hi,
             CASE WHEN count(DISTINCT {weekday(reference_date)}) > 1 OR count(DISTINCT {weekday(report_date)}) > 1 THEN 'daily' ELSE 'weekly' END AS resolution
      FROM {archive_a}),
    s AS (
      SELECT b.lo, b.hi, coalesce(u.first_origin, {plus(b.lo; 60)}) AS first_origin, coalesce(u.retraining_days, CASE WHEN b.resolution = 'weekly' THEN 14 ELSE 30 END) AS retraining_days,
             coalesce(u.training_days, 180) AS training_days, u.target_lag
      FROM b CROSS JOIN {asked_backtest} u WHERE b.lo IS NOT NULL)
    SELECT s.*, CASE WHEN retraining_days < 1 THEN 'the retraining interval must be at least one day' WHEN first_origin > hi THEN 'the first origin is after the last report'
                     WHEN first_origin < lo THEN 'the first origin is before the first report' END AS refused
    FROM s
""", public=False)
model("retraining_calendar", """
    WITH b AS (SELECT * FROM {archive_span} WHERE {refuse(refused)}),
    d AS (SELECT {steps({days(hi; first_origin)}; retraining_days)} AS i, b.* FROM b)
    SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS fold, {plus(first_origin; i)} AS test_date, target_lag, training_days, retraining_days AS testing_days,
           {plus(first_origin; max(i) OVER () + retraining_days)} AS experiment_end_date
    FROM d
""")
model("schedule_fallback", """
    WITH d AS (SELECT DISTINCT report_date FROM {archive_a}),
    r AS (SELECT report_date, row_number() OVER (ORDER BY report_date) AS place, count(*) OVER () AS n FROM d),
    p AS (SELECT * FROM (VALUES (1, 6e-1), (2, 72e-2), (3, 84e-2)) AS t(fold, share))
    SELECT p.fold, r.report_date AS test_date, {plus(max(r.report_date) OVER (); 30)} AS experiment_end_date
    FROM r JOIN p ON r.place = greatest(1, CAST(floor(p.share * r.n) AS BIGINT))
""")
model("scan_schedule", """
    SELECT fold, test_date, target_lag, training_days, testing_days, experiment_end_date FROM {retraining_calendar}
""")
model("schedule", """
    SELECT fold, test_date AS cutoff, training_days, testing_days, experiment_end_date,
           coalesce(lead(test_date) OVER (ORDER BY test_date), experiment_end_date) AS next_date
    FROM {retraining_calendar}
""", public=False)
model("build_cases", """
    SELECT /*+ BROADCAST(s) */ s.fold, s.cutoff, t.geo_value, t.reference_date, t.report_date, t.target_date, t.lag,
           t.log_value_target_7dav AS truth, t.log_value_7dav AS latest
    FROM {triangle} t JOIN {schedule} s ON t.report_date >= s.cutoff AND t.report_date < least({plus(s.cutoff; s.testing_days)}, s.next_date)
    WHERE coalesce(t.genuine_event, FALSE) AND t.log_value_target_7dav IS NOT NULL AND t.log_value_7dav IS NOT NULL AND t.lag <= 28
""")
model("completed_training", """
    SELECT /*+ BROADCAST(s) */ s.fold, s.cutoff, t.geo_value, t.reference_date, t.report_date, t.lag, t.target_date,
           t.log_value_7dav AS latest, t.log_value_target_7dav AS target, t.log_value_target_7dav - t.log_value_7dav AS remaining,
           t.target_date < s.cutoff AND t.genuine_event AS strict, t.genuine_event AS genuine
    FROM {triangle} t JOIN {schedule} s
      ON t.target_date > {plus(s.cutoff; 0 - s.training_days)} AND t.target_date <= s.cutoff AND t.report_date < s.cutoff
    WHERE t.lag <= 28
""")
model("attach_progress", """
    WITH f AS (
      SELECT geo_value, reference_date, report_date, lag, log_delta_value_7dav_lag7,
             row_number() OVER (PARTITION BY geo_value, reference_date, report_date, lag ORDER BY log_delta_value_7dav_lag7 DESC NULLS LAST) AS rn
      FROM {triangle})
    SELECT c.*, f.log_delta_value_7dav_lag7 AS progress
    FROM {build_cases} c LEFT JOIN f ON f.rn = 1 AND f.geo_value = c.geo_value AND f.reference_date = c.reference_date AND f.report_date = c.report_date AND f.lag = c.lag
""")
model("attach_context", """
    SELECT c.*, x.log_delta_value_7dav_lag7, x.inv_log_lag, x.mon_issue
    FROM {build_cases} c LEFT JOIN {issued_context_columns} x
      ON x.geo_value = c.geo_value AND x.reference_date = c.reference_date AND x.report_date = c.report_date AND x.lag = c.lag
""")
model("attach_process", """
    SELECT c.*, p.process_shift_score, p.process_state, p.process_shift_driver
    FROM {build_cases} c LEFT JOIN {process_shift} p ON p.cutoff = c.cutoff AND p.geo_value = c.geo_value
""")
