"""Vintage archives: one row per (geo_value, reference_date, report_date) with the value then known.

Columns geo_value, reference_date, report_date, lag, value. The archives here derive from the driver's tables.
"""

from ..models import model

model("archive_a", """
    WITH r AS (
      SELECT r_name AS geo_value, CAST(date_trunc('week', o_orderdate) AS DATE) AS reference_date,
             CAST(floor(l_quantity * l_quantity / 50.0) AS INT) AS lag, CAST(l_extendedprice AS DECIMAL(18, 2)) AS p
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
      JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey),
    g AS (SELECT geo_value, reference_date, lag, sum(p) AS p FROM r GROUP BY geo_value, reference_date, lag)
    SELECT geo_value, reference_date, {plus(reference_date; lag)} AS report_date, lag,
           CAST(sum(p) OVER (PARTITION BY geo_value, reference_date ORDER BY lag) AS DOUBLE) AS value
    FROM g
""", public=False)

model("archive_b", """
    WITH r AS (
      SELECT event_type AS geo_value, CAST(ts AS DATE) AS reference_date, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
      FROM {events}),
    g AS (
      SELECT geo_value, reference_date, CAST(floor(k * k / 400.0) AS INT) AS lag, count(*) AS n
      FROM r GROUP BY geo_value, reference_date, CAST(floor(k * k / 400.0) AS INT))
    SELECT geo_value, reference_date, {plus(reference_date; lag)} AS report_date, lag,
           CAST(CAST(sum(n) OVER (PARTITION BY geo_value, reference_date ORDER BY lag) AS BIGINT) AS DOUBLE) AS value
    FROM g
""", public=False)

# what each release replaces, and until when it holds: [lag, next_lag)
model("validity", """
    SELECT geo_value, reference_date, report_date, lag, value,
           lag(value) OVER (PARTITION BY geo_value, reference_date ORDER BY lag) AS before,
           lead(lag) OVER (PARTITION BY geo_value, reference_date ORDER BY lag) AS next_lag
    FROM {archive_normalize}
""", public=False)

# an archive with the marks of real files: other names, text, blanks, impossible and repeated rows
model("raw_file", """
    SELECT geo_value AS place, CAST(reference_date AS STRING) AS event, CAST(report_date AS STRING) AS issue,
           CASE WHEN lag % 11 = 5 THEN 'n/a' ELSE CAST(CAST(value AS BIGINT) AS STRING) END AS amount, CAST(1 AS BIGINT) AS seq
    FROM {archive_b}
    UNION ALL
    SELECT geo_value, CAST(reference_date AS STRING), CAST(report_date AS STRING), CAST(CAST(value AS BIGINT) + 1 AS STRING), CAST(2 AS BIGINT)
    FROM {archive_b} WHERE lag % 7 = 3
    UNION ALL
    SELECT geo_value, CAST(report_date AS STRING), CAST(reference_date AS STRING), '1', CAST(3 AS BIGINT)
    FROM {archive_b} WHERE lag % 5 = 4
""", public=False)

model("scan_archive", """
    SELECT geo_value, reference_date, report_date, value FROM {archive_a}
""")
model("scan_triangles", """
    SELECT geo_value, reference_date, report_date, lag, value FROM {archive_b}
""")
model("scan_mapped_archive", """
    SELECT place AS geo_value, TRY_CAST(event AS DATE) AS reference_date, TRY_CAST(issue AS DATE) AS report_date,
           {days(TRY_CAST(issue AS DATE); TRY_CAST(event AS DATE))} AS lag, TRY_CAST(amount AS DOUBLE) AS value, seq
    FROM {raw_file}
    WHERE {days(TRY_CAST(issue AS DATE); TRY_CAST(event AS DATE))} BETWEEN 0 AND 240
""")
