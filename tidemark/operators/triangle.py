"""Features and targets: what was known at each release, and what it became.

The definitions here are this library's own: the target is the value as known TARGET days after the reference
date (28 for the weekly archive, 21 for the daily one), features are differences and logarithms of as-of values.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from ..models import frame_model, model

# each release holds until the next, the last one as far as any lag of the archive
model("fill_lag_grid", """
    WITH g AS (
      SELECT v.geo_value, v.reference_date, {series(v.lag; coalesce(v.next_lag - 1, m.last_lag))} AS lag, v.value
      FROM {validity} v CROSS JOIN (SELECT max(lag) AS last_lag FROM {validity}) m)
    SELECT geo_value, reference_date, lag, {plus(reference_date; lag)} AS report_date, value FROM g
""")
model("trailing_mean_7", """
    SELECT geo_value, reference_date, lag, report_date,
           avg(value) OVER (PARTITION BY geo_value, report_date ORDER BY {days(reference_date; DATE '1970-01-01')} RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS value_7dav
    FROM {fill_lag_grid}
""")
model("log_features", """
    SELECT t.geo_value, t.reference_date, t.lag, ln(1 + t.value_7dav) AS log_value_7dav, ln(1 + a.value_7dav) AS log_value_7dav_denom,
           ln(1 + t.value_7dav) - ln(1 + a.value_7dav) AS log_ratio
    FROM {trailing_mean_7} t
    JOIN (SELECT reference_date, lag, sum(value_7dav) AS value_7dav FROM {trailing_mean_7} GROUP BY reference_date, lag) a
      ON a.reference_date = t.reference_date AND a.lag = t.lag
""")
model("validity_a", """
    SELECT geo_value, reference_date, report_date, lag, value,
           lag(value) OVER (PARTITION BY geo_value, reference_date ORDER BY lag) AS before,
           lead(lag) OVER (PARTITION BY geo_value, reference_date ORDER BY lag) AS next_lag
    FROM {archive_a}
""", public=False)
model("delayed_target", """
    SELECT v.geo_value, v.reference_date, {plus(v.reference_date; 28)} AS target_date, 28 AS target_lag, v.value AS target_value
    FROM {validity_a} v CROSS JOIN (SELECT max(report_date) AS last_report FROM {archive_a}) m
    WHERE v.lag <= 28 AND (v.next_lag IS NULL OR 28 < v.next_lag) AND {plus(v.reference_date; 28)} <= last_report
""")
model("revision_deltas", """
    SELECT v.geo_value, v.reference_date, v.report_date, v.lag, ln(1 + v.value) - ln(1 + p.value) AS log_delta_value_7dav_lag7
    FROM {validity_a} v
    JOIN {validity_a} p ON p.geo_value = v.geo_value AND p.reference_date = v.reference_date
      AND p.lag <= v.lag - 7 AND (p.next_lag IS NULL OR v.lag - 7 < p.next_lag)
""")
model("calendar_features", """
    SELECT geo_value, reference_date, report_date, lag, CASE WHEN {weekday(reference_date)} = 0 THEN 1 ELSE 0 END AS mon_ref,
           CASE WHEN {weekday(report_date)} = 0 THEN 1 ELSE 0 END AS mon_issue, CASE WHEN {weekday(report_date)} >= 5 THEN 1 ELSE 0 END AS weekends_issue,
           1 / ln(lag + 2) AS inv_log_lag
    FROM {archive_a}
""")
model("weekly_normalize", """
    SELECT geo_value, CAST(date_trunc('week', reference_date) AS DATE) AS reference_week, report_date,
           max_by(value, reference_date) AS value
    FROM {archive_b} GROUP BY geo_value, CAST(date_trunc('week', reference_date) AS DATE), report_date
""")
model("triangle", """
    SELECT v.geo_value, v.reference_date, v.report_date, v.lag, t.target_date, t.target_lag,
           ln(1 + v.value) AS log_value_7dav, ln(1 + t.target_value) AS log_value_target_7dav,
           coalesce(v.value <> v.before, FALSE) OR v.before IS NULL AS genuine_event,
           d.log_delta_value_7dav_lag7, c.mon_issue, c.inv_log_lag
    FROM {validity_a} v
    LEFT JOIN {delayed_target} t ON t.geo_value = v.geo_value AND t.reference_date = v.reference_date
    LEFT JOIN {revision_deltas} d ON d.geo_value = v.geo_value AND d.reference_date = v.reference_date AND d.lag = v.lag
    LEFT JOIN {calendar_features} c ON c.geo_value = v.geo_value AND c.reference_date = v.reference_date AND c.lag = v.lag
""")
#: What names of columns that are known at issue look like.
CONTEXT = (r"log_delta_value_7dav_lag\d+", r"inv_log_lag", r"\w+_ref", r"\w+_issue")


def _context(triangle: DataFrame) -> DataFrame:
    """The key, and the numeric columns that are context by their names, as many as there are."""
    numbers = {f.name for f in triangle.schema if isinstance(f.dataType, NumericType)}
    return triangle.select("geo_value", "reference_date", "report_date", "lag", *(c for c in triangle.columns if c in numbers and re.fullmatch("|".join(CONTEXT), c)))


frame_model("issued_context_columns", ("triangle",), _context, sql="""
    SELECT geo_value, reference_date, report_date, lag, log_delta_value_7dav_lag7, inv_log_lag, mon_issue FROM {triangle}
""")
