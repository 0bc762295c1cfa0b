"""Projections, filters and diagnosis of an archive (columns as in sources.archives)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored
from . import order

# Keep the last release, in order of arrival, of each (location, reference date, report date); drop rows that
# cannot be read, and reports before their reference date.
model("archive_typed", """
    SELECT place AS geo_value, TRY_CAST(event AS DATE) AS reference_date, TRY_CAST(issue AS DATE) AS report_date,
           TRY_CAST(amount AS DOUBLE) AS value, seq
    FROM {raw_file}
""", public=False)
model("archive_normalize", """
    SELECT geo_value, reference_date, report_date, {days(report_date; reference_date)} AS lag, value
    FROM (
      SELECT *, row_number() OVER (PARTITION BY geo_value, reference_date, report_date ORDER BY seq DESC, value DESC) AS rn
      FROM {archive_typed}
      WHERE geo_value IS NOT NULL AND value IS NOT NULL AND report_date >= reference_date) t
    WHERE rn = 1
""")
model("fraction_value", """
    SELECT d.reference_date, d.report_date, n.value AS numerator, d.value AS denominator,
           CASE WHEN d.value > 0 THEN n.value / d.value END AS value
    FROM (SELECT reference_date, report_date, sum(value) AS value FROM {archive_b} GROUP BY reference_date, report_date) d
    LEFT JOIN (SELECT reference_date, report_date, value FROM {archive_b} WHERE geo_value = 'purchase') n
      ON n.reference_date = d.reference_date AND n.report_date = d.report_date
""")
model("single_location", """
    SELECT 'all' AS geo_value, reference_date, report_date, CAST(sum(value) AS DOUBLE) AS value
    FROM {archive_b} GROUP BY reference_date, report_date
""")
model("clip_experiment_window", """
    WITH s AS (SELECT min(test_date) AS lo, max(test_date) AS hi FROM {schedule_fallback})
    SELECT a.* FROM {archive_a} a CROSS JOIN s
    WHERE a.lag BETWEEN 0 AND 28 + 100
      AND a.reference_date >= {plus(lo; 0 - 180 - 28 - 7 - 35)} AND a.report_date <= {plus(hi; 28)}
""")
model("location_support", """
    SELECT geo_value, CAST(count(*) AS BIGINT) AS raw_rows, CAST(sum(CASE WHEN genuine THEN 1 ELSE 0 END) AS BIGINT) AS genuine_rows,
           min(report_date) AS first_report, max(report_date) AS last_report,
           CASE WHEN count(*) < 100 THEN 'fewer rows than required' END AS skipped_because
    FROM {genuine_events} GROUP BY geo_value
""")
model("lag_band", """
    SELECT geo_value, reference_date, lag,
           CASE WHEN lag <= 7 THEN '(-inf,7]' WHEN lag <= 14 THEN '(7,14]' WHEN lag <= 28 THEN '(14,28]' ELSE '(28,inf)' END AS band
    FROM {archive_a}
""")
model("lag_groups", """
    SELECT * FROM (VALUES ('0-3', 0, 3), ('4-7', 4, 7), ('8-14', 8, 14), ('15-28', 15, 28), ('29-50', 29, 50)) AS t(lag_group, lo, hi)
""", public=False)
model("lag_group_assign", """
    SELECT a.geo_value, a.reference_date, a.lag, g.lag_group, (a.lag BETWEEN g.lo AND g.hi) AS testing
    FROM {archive_a} a JOIN {lag_groups} g ON a.lag BETWEEN g.lo - 1 AND g.hi + 1
""")
model("to_raw_scale", """
    SELECT geo_value, reference_date, lag, ln(1 + value) AS working, exp(ln(1 + value)) - 1 AS from_log1p,
           exp(ln(value + 1) - ln(1 + 1)) AS from_log, value AS from_identity
    FROM {archive_b}
""")

# -- diagnosis ----------------------------------------------------------------------------------------------
model("axis_resolution", """
    WITH d AS (
      SELECT DISTINCT 'reference' AS axis, reference_date AS d FROM {archive_normalize}
      UNION ALL SELECT DISTINCT 'report', report_date FROM {archive_normalize}),
    w AS (SELECT axis, {weekday(d)} AS weekday, count(*) AS n FROM d GROUP BY axis, {weekday(d)}),
    s AS (SELECT *, sum(n) OVER (PARTITION BY axis) AS total, count(*) OVER (PARTITION BY axis) AS kinds FROM w)
    SELECT axis, weekday, round(CAST(n AS DOUBLE) / total, 4) AS share, CASE WHEN kinds > 1 THEN 'daily' ELSE 'weekly' END AS axis_resolution,
           CASE WHEN max(kinds) OVER () > 1 THEN 'daily' ELSE 'weekly' END AS resolution
    FROM s
""")
model("genuine_events", """
    SELECT geo_value, reference_date, report_date, lag, value, coalesce(value <> before, FALSE) AS genuine FROM {validity}
""")
model("genuine_rate", """
    WITH w AS (SELECT {weekday(report_date)} AS weekday, count(*) AS n FROM {genuine_events} WHERE genuine GROUP BY {weekday(report_date)})
    SELECT weekday, CAST(n AS DOUBLE) / sum(n) OVER () AS share,
           (SELECT avg(CASE WHEN genuine THEN 1e0 ELSE 0e0 END) FROM {genuine_events}) AS genuine_rate
    FROM w
""")
model("gaps", """
    SELECT geo_value, {days(report_date; lag(report_date) OVER (PARTITION BY geo_value, reference_date ORDER BY report_date))} AS gap
    FROM {genuine_events} WHERE genuine
""", public=False)


def _gaps(gaps: DataFrame) -> DataFrame:
    """Gaps are counted once, and all that is said of them is said of the counts."""
    counts = stored(gaps.where("gap IS NOT NULL").groupBy("gap").agg(F.count(F.lit(1)).alias("n")), "gaps")
    top = counts.orderBy(F.desc("n"), "gap").limit(3).select(F.expr("CAST(row_number() OVER (ORDER BY n DESC, gap) AS INT)").alias("place"), F.col("gap").alias("common_gap"), F.col("n").alias("common_n"))
    values = order.cumulated(counts.withColumn("one", F.lit(1)), ["one"], "gap")
    levels = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    found = order.at_levels(values, ["one"], "gap", levels).join(counts.agg(F.sum("n").alias("n")))
    return found.crossJoin(F.broadcast(top)).select("n", *(F.round(c, 2).alias(c) for c in levels), "place", "common_gap", "common_n")


frame_model("revision_gaps", ("gaps",), _gaps, sql="""
    WITH g AS (SELECT gap FROM {gaps} WHERE gap IS NOT NULL),
    top AS (SELECT gap, row_number() OVER (ORDER BY count(*) DESC, gap) AS place, count(*) AS n FROM g GROUP BY gap)
    SELECT CAST((SELECT count(*) FROM g) AS BIGINT) AS n, round((SELECT {pct(gap; 25e-2)} FROM g), 2) AS q25,
           round((SELECT {pct(gap; 5e-1)} FROM g), 2) AS median, round((SELECT {pct(gap; 75e-2)} FROM g), 2) AS q75,
           CAST(place AS INT) AS place, gap AS common_gap, CAST(top.n AS BIGINT) AS common_n
    FROM top WHERE place <= 3
""")
model("reference_cadence", """
    WITH d AS (SELECT DISTINCT geo_value, reference_date FROM {archive_normalize}),
    g AS (SELECT geo_value, {days(reference_date; lag(reference_date) OVER (PARTITION BY geo_value ORDER BY reference_date))} AS gap FROM d),
    m AS (SELECT geo_value, {pct(gap; 5e-1)} AS gap FROM g WHERE gap IS NOT NULL GROUP BY geo_value)
    SELECT {pct(gap; 5e-1)} AS cadence, {pct(gap; 5e-1)} AS first_lag, 2 * {pct(gap; 5e-1)} AS second_lag FROM m
""")
model("candidate_lags", """
    SELECT * FROM (VALUES (0), (7), (14), (21), (28), (35), (42), (49), (56)) AS t(candidate)
""", public=False)
model("final_values", """
    SELECT geo_value, reference_date, max_by(value, lag) AS final_value, max(lag) AS last_lag FROM {archive_normalize} GROUP BY geo_value, reference_date
""", public=False)
# Errors of the as-of value against the last, for reference dates at least 20 days before the last report
# (archives shorter than two months; the usual distance is 60 days).
model("completion_errors", """
    SELECT c.candidate, v.geo_value, v.reference_date, abs(v.value - f.final_value) / greatest(abs(f.final_value), 1e-12) AS error
    FROM {validity} v
    JOIN {candidate_lags} c ON v.lag <= c.candidate AND (v.next_lag IS NULL OR c.candidate < v.next_lag)
    JOIN {final_values} f ON f.geo_value = v.geo_value AND f.reference_date = v.reference_date
    CROSS JOIN (SELECT max(report_date) AS last_report FROM {archive_normalize}) m
    WHERE {days(last_report; v.reference_date)} >= 20
""", public=False)
model("completion_curve", """
    WITH t AS (
      SELECT candidate, CAST(count(*) AS BIGINT) AS episodes,
             avg(CASE WHEN error <= 1e-1 * (1 + 1e-6) + 1e-8 THEN 1e0 ELSE 0e0 END) AS rate,
             {pct(error; 5e-1)} AS median_error, {pct(error; 1e-1)} AS q10, {pct(error; 9e-1)} AS q90
      FROM {completion_errors} GROUP BY candidate)
    SELECT t.*, candidate = coalesce(min(CASE WHEN rate >= 9e-1 THEN candidate END) OVER (), max(candidate) OVER ()) AS recommended FROM t
""")
model("archive_report", """
    SELECT CAST((SELECT count(*) FROM {archive_normalize}) AS BIGINT) AS n_rows, CAST((SELECT count(DISTINCT geo_value) FROM {archive_normalize}) AS BIGINT) AS locations,
           (SELECT min(reference_date) FROM {archive_normalize}) AS first_reference, (SELECT max(report_date) FROM {archive_normalize}) AS last_report,
           (SELECT max(resolution) FROM {axis_resolution}) AS resolution, (SELECT max(genuine_rate) FROM {genuine_rate}) AS genuine_rate,
           (SELECT max(median) FROM {revision_gaps}) AS median_gap, (SELECT max(cadence) FROM {reference_cadence}) AS cadence,
           (SELECT max(candidate) FROM {completion_curve} WHERE recommended) AS target_lag,
           CASE WHEN (SELECT count(DISTINCT geo_value) FROM {archive_normalize}) = 1 THEN 'single location' END AS location_note,
           CASE WHEN (SELECT max(genuine_rate) FROM {genuine_rate}) < 2e-2 THEN 'few genuine revisions' END AS rate_note
""")
# user_settings: what a user asks for in place of what the archive suggests; null is not asked for.
model("user_settings", """
    SELECT CAST(NULL AS INT) AS target_lag, CAST(NULL AS STRING) AS lag_terms, CAST(NULL AS BOOLEAN) AS smoothed, CAST(NULL AS INT) AS training_days,
           CAST(NULL AS INT) AS retraining_days, CAST(NULL AS STRING) AS weekday_groups, CAST(NULL AS STRING) AS target_column
""", public=False)
_ASKED = ("target_lag", "lag_terms", "smoothed", "training_days", "retraining_days", "weekday_groups", "target_column")
model("preparation_settings", f"""
    WITH d AS (
      SELECT r.resolution, CAST(coalesce(r.target_lag, 0) AS INT) AS target_lag, CASE WHEN r.resolution = 'weekly' THEN '7,14' ELSE '1,7' END AS lag_terms,
             r.resolution = 'daily' AS smoothed, 180 AS training_days, CASE WHEN r.resolution = 'weekly' THEN 14 ELSE 30 END AS retraining_days,
             CASE WHEN r.resolution = 'daily' THEN 'mon,weekends' ELSE '' END AS weekday_groups,
             CASE WHEN coalesce(u.smoothed, r.resolution = 'daily') THEN 'log_value_target_7dav' ELSE 'log_value_target' END AS target_column
      FROM {{archive_report}} r CROSS JOIN {{user_settings}} u)
    SELECT d.resolution, {', '.join(f'coalesce(u.{c}, d.{c}) AS {c}' for c in _ASKED)},
           concat_ws(',', {', '.join(f"CASE WHEN u.{c} IS NOT NULL THEN '{c}' END" for c in _ASKED)}) AS overrides
    FROM d CROSS JOIN {{user_settings}} u
""")
# what each location by itself would suggest, against the lag that the whole archive was set to
model("lag_choices", """
    WITH e AS (
      SELECT geo_value, candidate, avg(CASE WHEN error <= 1e-1 * (1 + 1e-6) + 1e-8 THEN 1e0 ELSE 0e0 END) AS rate FROM {completion_errors} GROUP BY geo_value, candidate),
    g AS (SELECT geo_value, coalesce(min(CASE WHEN rate >= 9e-1 THEN candidate END), max(candidate)) AS suggested_lag FROM e GROUP BY geo_value),
    u AS (SELECT max(target_lag) AS user_lag FROM {preparation_settings})
    SELECT g.geo_value, CAST(u.user_lag AS INT) AS user_lag, g.suggested_lag, c.confirmed FROM g CROSS JOIN u CROSS JOIN (VALUES (TRUE), (FALSE)) AS c(confirmed)
    UNION ALL SELECT geo_value, CAST(NULL AS INT), suggested_lag, TRUE FROM g
""", public=False)
model("resolve_target_lag", """
    SELECT geo_value, user_lag, suggested_lag, confirmed, coalesce(greatest(user_lag, suggested_lag), suggested_lag, user_lag) AS larger_wins,
           CASE WHEN user_lag IS NULL THEN suggested_lag WHEN suggested_lag IS NULL OR user_lag >= suggested_lag OR confirmed THEN user_lag END AS user_wins,
           coalesce(user_lag < suggested_lag AND NOT confirmed, FALSE) AS needs_confirmation
    FROM {lag_choices}
""")
# what a user specified (here: settings for a weekly archive) against what the archive shows, key by key
model("profile_disagreement", """
    WITH d AS (SELECT max(lag_terms) AS lag_terms, max(grouping_rule) AS grouping_rule, CAST(max(active_days) AS STRING) AS active_days FROM {revision_profile}),
    w AS (
      SELECT CASE WHEN sum(CASE WHEN mon_issue = 1 THEN 1 ELSE 0 END) > 0 THEN 'mon' ELSE '' END AS present FROM {triangle}),
    k AS (
      SELECT 'lag_terms' AS setting, '7,14' AS specified, lag_terms AS derived FROM d UNION ALL SELECT 'grouping_rule', 'monday and weekends', grouping_rule FROM d
      UNION ALL SELECT 'active_days', '7', active_days FROM d UNION ALL SELECT 'weekday_columns', 'mon', present FROM w)
    SELECT setting, specified, derived, specified AS effective, NOT specified = derived AS disagrees FROM k
""")
model("revision_profile", """
    WITH w AS (SELECT {weekday(report_date)} AS weekday, count(*) AS n FROM {genuine_events} WHERE genuine GROUP BY {weekday(report_date)}),
    s AS (SELECT weekday, CAST(n AS DOUBLE) / sum(n) OVER () AS share FROM w),
    a AS (SELECT count(*) AS active FROM s WHERE share >= 8e-2),
    g AS (SELECT {pct(gap; 5e-1)} AS median_gap FROM {gaps} WHERE gap IS NOT NULL)
    SELECT s.weekday, s.share, s.share >= 8e-2 AS active_day, CAST(a.active AS BIGINT) AS active_days,
           CASE WHEN a.active >= 6 THEN 'monday and weekends' WHEN a.active = 0 THEN 'none' ELSE 'each active day' END AS grouping_rule,
           CASE WHEN g.median_gap <= 15e-1 THEN '1,7' ELSE '7,14' END AS lag_terms
    FROM s CROSS JOIN a CROSS JOIN g
""")
model("triangle_summary", """
    WITH k AS (SELECT geo_value, reference_date, report_date, count(*) AS n FROM {triangle} GROUP BY geo_value, reference_date, report_date)
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT geo_value) AS BIGINT) AS locations, min(reference_date) AS first_reference,
           max(reference_date) AS last_reference, min(report_date) AS first_report, max(report_date) AS last_report,
           CAST(min(lag) AS INT) AS min_lag, CAST(max(lag) AS INT) AS max_lag, CAST(count(DISTINCT target_lag) AS BIGINT) AS target_lags,
           CAST((SELECT count(*) FROM k WHERE n > 1) AS BIGINT) AS duplicate_keys
    FROM {triangle}
""")


def _missingness(triangle: DataFrame) -> DataFrame:
    """Every column of a triangle, whatever it has: how many rows lack it. One pass."""
    columns = triangle.columns
    counts = triangle.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit(c).alias("column_name"), (F.col("_n") - F.col(f"_{i}")).alias("missing")) for i, c in enumerate(columns)]
    out = counts.select("_n", F.explode(F.array(*rows)).alias("r"))
    return out.select("r.column_name", "r.missing", (F.col("r.missing") / F.when(F.col("_n") > 0, F.col("_n"))).alias("fraction"))


_COLUMNS = ("geo_value", "reference_date", "report_date", "lag", "target_date", "target_lag", "log_value_7dav", "log_value_target_7dav", "genuine_event", "log_delta_value_7dav_lag7", "mon_issue", "inv_log_lag")
frame_model("missingness", ("triangle",), _missingness, sql=f"""
    WITH t AS (SELECT count(*) AS n, {', '.join(f'count({c}) AS c_{c}' for c in _COLUMNS)} FROM {{triangle}})
    SELECT column_name, CAST(missing AS BIGINT) AS missing, CAST(missing AS DOUBLE) / nullif(n, 0) AS fraction FROM ({' UNION ALL '.join(f"SELECT n, '{c}' AS column_name, n - c_{c} AS missing FROM t" for c in _COLUMNS)}) u
""")
# lag_search: what a user asks of the search; null is not asked for. Days between candidates, the last report that counts, the days of
# later reports that an episode must have beyond a candidate, and the largest lag at which it must first be reported.
model("lag_search", """
    SELECT 7 AS cadence_days, CAST(NULL AS DATE) AS cutoff, CAST(NULL AS INT) AS follow_up, CAST(NULL AS INT) AS first_lag, 9e-1 AS wanted
""", public=False)
model("searched", """
    WITH s AS (SELECT * FROM {lag_search}),
    a AS (SELECT n.* FROM {archive_normalize} n CROSS JOIN s WHERE s.cutoff IS NULL OR n.report_date <= s.cutoff)
    SELECT a.geo_value, a.reference_date, a.lag, a.value, lead(a.lag) OVER w AS next_lag, min(a.lag) OVER e AS first_lag, max(a.lag) OVER e AS last_lag, max_by(a.value, a.lag) OVER e AS final_value
    FROM a WINDOW w AS (PARTITION BY geo_value, reference_date ORDER BY lag), e AS (PARTITION BY geo_value, reference_date)
""", public=False)
# candidates go as far as the archive's lags do; a release is what was known at each candidate from its lag to the next release's
model("target_lag_asof", """
    WITH s AS (SELECT * FROM {lag_search}),
    m AS (SELECT max({plus(reference_date; lag)}) AS last_report, max(lag) AS reach, count(*) AS n FROM {searched}),
    c AS (SELECT {steps(m.reach; s.cadence_days)} AS candidate FROM m CROSS JOIN s WHERE m.reach >= s.cadence_days),
    old AS (
      SELECT v.*, s.cadence_days, m.reach FROM {searched} v CROSS JOIN s CROSS JOIN m
      WHERE (s.first_lag IS NULL OR v.first_lag <= s.first_lag)),
    g AS (
      SELECT geo_value, reference_date, value, final_value, last_lag,
             {series({cell(lag + cadence_days - 1; cadence_days)}; {cell(coalesce(next_lag - 1, reach); cadence_days)})} AS times
      FROM old WHERE {cell(lag + cadence_days - 1; cadence_days)} <= {cell(coalesce(next_lag - 1, reach); cadence_days)}),
    e AS (
      SELECT g.times * s.cadence_days AS candidate, abs(g.value - g.final_value) / greatest(abs(g.final_value), 1e-12) AS error
      FROM g CROSS JOIN s CROSS JOIN m
      WHERE g.times > 0 AND {days(m.last_report; g.reference_date)} >= g.times * s.cadence_days AND (s.follow_up IS NULL OR g.last_lag >= g.times * s.cadence_days + s.follow_up)),
    r AS (
      SELECT candidate, CAST(count(*) AS BIGINT) AS episodes, avg(CASE WHEN error <= 1e-1 * (1 + 1e-6) + 1e-8 THEN 1e0 ELSE 0e0 END) AS rate, {pct(error; 5e-1)} AS median_error
      FROM e GROUP BY candidate),
    f AS (SELECT min(CASE WHEN r.rate >= s.wanted THEN r.candidate END) AS selected, count(r.candidate) AS n FROM s LEFT JOIN r ON TRUE),
    k AS (SELECT candidate FROM c WHERE candidate > 0)
    SELECT k.candidate, coalesce(r.episodes, 0) AS episodes, r.rate, r.median_error, f.selected,
           CASE WHEN m.n = 0 THEN 'no reports' WHEN m.reach < s.cadence_days THEN 'no report is late enough for a candidate' WHEN f.n = 0 THEN 'no episode is old enough'
                WHEN f.selected IS NULL THEN 'no lag reaches the rate' ELSE 'selected' END AS status
    FROM s CROSS JOIN m CROSS JOIN f LEFT JOIN k ON TRUE LEFT JOIN r ON r.candidate = k.candidate
""")
