"""Forecast methods over all origins at once, their long form and their scores."""

from ..models import model

#: Levels of the quantiles that forecasts carry, and the columns that hold them.
TAUS = ("1e-2", "25e-3", "1e-1", "25e-2", "5e-1", "75e-2", "9e-1", "975e-3", "99e-2")
QS = ("q0_01", "q0_025", "q0_1", "q0_25", "q0_5", "q0_75", "q0_9", "q0_975", "q0_99")
KEY = ("fold", "cutoff", "geo_value", "reference_date", "report_date", "target_date", "lag")


def keys(alias: str, *more: str, without: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{alias}.{c}" for c in (*KEY, *more) if c not in without)


def same(a: str, b: str, columns: tuple[str, ...] = ("fold", "geo_value", "reference_date", "report_date")) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in columns)


def wis(y: str, suffix: str = "", alias: str = "") -> str:
    """Weighted interval score of the nine quantiles."""
    q = [f"{alias}{q}{suffix}" for q in QS]
    return "(" + " + ".join(f"2 * greatest({t} * ({y} - {c}), (1 - {t}) * ({c} - {y}))" for t, c in zip(TAUS, q)) + ") / 9"


model("carry_forward", f"""
    SELECT {keys('c')}, c.latest AS prediction, {', '.join(f'c.latest AS {q}' for q in QS)} FROM {{build_cases}} c
""")
# For each origin, location and lag the distribution of the revisions that completed before the origin.
model("remaining_quantiles", f"""
    SELECT fold, geo_value, lag, CAST(count(*) AS BIGINT) AS n, {', '.join(f'{{pct(remaining; {t})}} AS {q}' for t, q in zip(TAUS, QS))}
    FROM {{completed_training}} GROUP BY fold, geo_value, lag
""", public=False)
model("register_method", f"""
    SELECT {keys('c')}, c.latest + r.q0_5 AS prediction, {', '.join(f'c.latest + r.{q} AS {q}' for q in QS)}
    FROM {{build_cases}} c LEFT JOIN {{remaining_quantiles}} r ON r.fold = c.fold AND r.geo_value = c.geo_value AND r.lag = c.lag AND r.n >= 5
""")
model("standardize_predictions", f"""
    WITH w AS (
      SELECT {keys('p')}, 'carry_forward' AS method, p.prediction, {', '.join('p.' + q for q in QS)} FROM {{carry_forward}} p
      UNION ALL SELECT {keys('p')}, 'median_remaining', p.prediction, {', '.join('p.' + q for q in QS)} FROM {{register_method}} p),
    j AS (SELECT w.*, c.truth, c.latest FROM w JOIN {{build_cases}} c ON {same('c', 'w')})
    SELECT {keys('j', 'method')}, exp(truth) - 1 AS truth, exp(prediction) - 1 AS prediction, truth AS truth_working, prediction AS prediction_working,
           exp(latest) - 1 AS provisional_value, latest AS provisional_working, truth - latest AS true_remaining_revision, prediction - latest AS predicted_remaining_revision,
           prediction IS NOT NULL AS model_available, q0_01 IS NOT NULL AS has_distribution,
           abs(exp(truth) - exp(prediction)) AS absolute_error, abs(truth - prediction) AS absolute_error_working, {wis('truth')} AS wis_working,
           {', '.join(f'exp({q}) - 1 AS {q}' for q in QS)}, {', '.join(f'{q} AS {q}_working' for q in QS)}
    FROM j
""")
model("wis", f"""
    SELECT {keys('l', 'method')}, {wis('truth_working', '_working')} AS wis_working, {wis('truth')} AS wis FROM {{standardize_predictions}} l
""")
model("long", f"""
    SELECT l.*, {wis('truth')} AS wis FROM {{standardize_predictions}} l
""", public=False)
model("matched_cases", f"""
    WITH m AS (
      SELECT fold, geo_value, reference_date, report_date FROM {{long}} WHERE model_available
      GROUP BY fold, geo_value, reference_date, report_date HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM {{long}}))
    SELECT {keys('l', 'method')}, l.absolute_error, l.absolute_error_working, l.wis, l.wis_working, l.true_remaining_revision
    FROM {{long}} l LEFT SEMI JOIN m ON {same('m', 'l')}
""".replace("LEFT SEMI JOIN", "{semi(x)}"))
# what another program might hand in: one method, text fields, repeats, a value that is no number
model("external_file", """
    SELECT geo_value, CAST(reference_date AS STRING) AS reference_date, CAST(report_date AS STRING) AS report_date, CAST(lag AS STRING) AS lag, 'external' AS method,
           CASE WHEN lag = 9 THEN 'none' ELSE CAST(round(latest, 6) AS STRING) END AS prediction
    FROM {build_cases} WHERE lag % 3 = 0
    UNION ALL
    SELECT geo_value, CAST(reference_date AS STRING), CAST(report_date AS STRING), CAST(lag AS STRING), 'external', '0' FROM {build_cases} WHERE lag = 6
    UNION ALL SELECT 'nowhere', 'no date', '2000-01-01', '1', 'external', '1'
""", public=False)
model("external_predictions", f"""
    WITH e AS (
      SELECT geo_value, TRY_CAST(reference_date AS DATE) AS reference_date, TRY_CAST(report_date AS DATE) AS report_date, min(TRY_CAST(prediction AS DOUBLE)) AS prediction
      FROM {{external_file}} WHERE method = 'external' GROUP BY geo_value, TRY_CAST(reference_date AS DATE), TRY_CAST(report_date AS DATE) HAVING count(*) = 1)
    SELECT {keys('c')}, e.prediction AS external, e.prediction IS NOT NULL AS external_available
    FROM {{build_cases}} c LEFT JOIN e ON {same('e', 'c', ('geo_value', 'reference_date', 'report_date'))}
""")
model("external_predictions_check", """
    SELECT issue, CAST(n AS BIGINT) AS n FROM (
      SELECT 'duplicate key' AS issue, count(*) AS n FROM (SELECT 1 AS one FROM {external_file} GROUP BY geo_value, reference_date, report_date, method HAVING count(*) > 1) d
      UNION ALL SELECT 'prediction is not a number', count(*) FROM {external_file} WHERE TRY_CAST(prediction AS DOUBLE) IS NULL
      UNION ALL SELECT 'date cannot be read', count(*) FROM {external_file} WHERE TRY_CAST(reference_date AS DATE) IS NULL OR TRY_CAST(report_date AS DATE) IS NULL
      UNION ALL SELECT 'method is missing', count(*) FROM (VALUES ('external'), ('another')) AS w(method) WHERE method NOT IN (SELECT method FROM {external_file})) u
    WHERE n > 0
""")
# one set of rows for each origin, lag group and location; the global sets have a mark for each location instead
model("train_sets_local", """
    SELECT t.fold, g.lag_group, t.geo_value, t.reference_date, t.report_date, t.lag, t.latest, t.target, t.remaining, t.lag BETWEEN g.lo AND g.hi AS tested
    FROM {completed_training} t JOIN {lag_groups} g ON t.lag BETWEEN g.lo - 1 AND g.hi + 1 WHERE t.strict
""")
model("train_sets_global", """
    WITH l AS (SELECT geo_value, CAST(row_number() OVER (ORDER BY geo_value) AS INT) AS place, CAST(count(*) OVER () AS INT) AS n FROM (SELECT DISTINCT geo_value FROM {completed_training} WHERE strict) d)
    SELECT t.fold, g.lag_group, t.geo_value, t.reference_date, t.lag, t.remaining, concat(repeat('0', l.place - 1), '1', repeat('0', l.n - l.place)) AS indicators
    FROM {completed_training} t JOIN {lag_groups} g ON t.lag BETWEEN g.lo - 1 AND g.hi + 1 JOIN l ON l.geo_value = t.geo_value WHERE t.strict
""")
model("complete_test_rows", """
    SELECT * FROM {attach_context} WHERE log_delta_value_7dav_lag7 IS NOT NULL AND inv_log_lag IS NOT NULL AND mon_issue IS NOT NULL
""")
