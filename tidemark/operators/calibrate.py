"""Calibration and reliability from each origin's own past.

History of an origin: forecasts of the same method from earlier origins whose targets were known by then. For
each (origin, method, location, lag) the first of four strata with enough rows is used: same location and lag,
same location and lags one apart, all locations and the lag, all locations and lags one apart.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored
from . import order
from .forecast import KEY, QS, TAUS, keys, same, wis

MINIMUM = 10
STRATUM = ("fold", "method", "geo_value", "lag")

model("history", """
    SELECT /*+ BROADCAST(s) */ s.fold, l.method, l.geo_value, l.lag, l.fold AS from_fold, l.reference_date, l.report_date
    FROM {long} l JOIN {schedule} s ON l.cutoff < s.cutoff AND l.target_date <= s.cutoff
    WHERE l.model_available AND l.has_distribution
""", public=False)
model("scored", """
    SELECT l.*, c.absolute_error_working AS null_error, l.absolute_error_working - c.absolute_error_working AS regret,
           l.absolute_error_working > c.absolute_error_working AS harm
    FROM {long} l JOIN {long} c ON c.method = 'carry_forward' AND """ + same("c", "l") + """
""", public=False)


def _strata(name: str, counted: str, public: bool) -> None:
    """counted: condition on a scored row that makes it count."""
    model(f"{name}_counts", f"""
        SELECT h.fold, h.method, h.geo_value, h.lag, CAST(count(*) AS BIGINT) AS n
        FROM {{history}} h JOIN {{scored}} s ON s.method = h.method AND s.fold = h.from_fold AND {same('s', 'h', ('geo_value', 'reference_date', 'report_date'))}
        WHERE {counted} GROUP BY h.fold, h.method, h.geo_value, h.lag
    """, public=False)
    model(name, f"""
        WITH k AS (SELECT DISTINCT fold, method, geo_value, lag FROM {{long}}),
        g AS (SELECT fold, method, lag, sum(n) AS n FROM {{{name}_counts}} GROUP BY fold, method, lag),
        a AS (SELECT k.*, coalesce(c.n, 0) AS n1 FROM k LEFT JOIN {{{name}_counts}} c ON {same('c', 'k', STRATUM)}),
        b AS (SELECT k.fold, k.method, k.geo_value, k.lag, sum(c.n) AS n2 FROM k JOIN {{{name}_counts}} c ON {same('c', 'k', STRATUM[:3])} AND c.lag BETWEEN k.lag - 1 AND k.lag + 1 GROUP BY k.fold, k.method, k.geo_value, k.lag),
        d AS (SELECT k.fold, k.method, k.lag, sum(g.n) AS n4 FROM (SELECT DISTINCT fold, method, lag FROM k) k JOIN g ON {same('g', 'k', STRATUM[:2])} AND g.lag BETWEEN k.lag - 1 AND k.lag + 1 GROUP BY k.fold, k.method, k.lag),
        n AS (
          SELECT a.fold, a.method, a.geo_value, a.lag, a.n1, coalesce(b.n2, 0) AS n2, coalesce(g.n, 0) AS n3, coalesce(d.n4, 0) AS n4
          FROM a LEFT JOIN b ON {same('b', 'a', STRATUM)} LEFT JOIN g ON {same('g', 'a', ('fold', 'method', 'lag'))} LEFT JOIN d ON {same('d', 'a', ('fold', 'method', 'lag'))})
        SELECT fold, method, geo_value, lag,
               CASE WHEN n1 >= {MINIMUM} THEN 'location/exact' WHEN n2 >= {MINIMUM} THEN 'location/near' WHEN n3 >= {MINIMUM} THEN 'global/exact' WHEN n4 >= {MINIMUM} THEN 'global/near' ELSE 'insufficient history' END AS level,
               CAST(CASE WHEN n1 >= {MINIMUM} THEN n1 WHEN n2 >= {MINIMUM} THEN n2 WHEN n3 >= {MINIMUM} THEN n3 WHEN n4 >= {MINIMUM} THEN n4 ELSE 0 END AS BIGINT) AS n
        FROM n
    """, public=public)
    rows = " UNION ALL ".join(
        f"""SELECT s.fold, s.method, s.geo_value, s.lag, h.from_fold, h.geo_value AS from_geo, h.reference_date, h.report_date FROM {{{name}}} s
            JOIN {{history}} h ON h.fold = s.fold AND h.method = s.method{where} WHERE s.level = '{level}'"""
        for level, where in (
            ("location/exact", " AND h.geo_value = s.geo_value AND h.lag = s.lag"),
            ("location/near", " AND h.geo_value = s.geo_value AND h.lag BETWEEN s.lag - 1 AND s.lag + 1"),
            ("global/exact", " AND h.lag = s.lag"),
            ("global/near", " AND h.lag BETWEEN s.lag - 1 AND s.lag + 1"),
        )
    )
    model(f"{name}_rows", f"""
        SELECT m.fold, m.method, m.geo_value, m.lag, s.absolute_error_working, s.regret, s.harm, s.truth_working, {', '.join(f's.{q}_working' for q in QS)}
        FROM ({rows}) m JOIN {{scored}} s ON s.method = m.method AND s.fold = m.from_fold AND s.geo_value = m.from_geo AND s.reference_date = m.reference_date AND s.report_date = m.report_date
        WHERE {counted}
    """, public=False)


_strata("history_strata", "s.model_available", True)
_strata("harm_strata", "s.harm AND s.regret > 0", False)

model("upper_order_statistic", """
    SELECT fold, method, geo_value, lag, n, x AS q_error FROM (
      SELECT fold, method, geo_value, lag, absolute_error_working AS x, count(*) OVER (PARTITION BY fold, method, geo_value, lag) AS n,
             row_number() OVER (PARTITION BY fold, method, geo_value, lag ORDER BY absolute_error_working) AS place
      FROM {history_strata_rows}) t
    WHERE place = least(n, CAST(ceil((n + 1) * 9e-1) AS BIGINT))
""")
model("quantile_higher", """
    SELECT fold, method, geo_value, lag, n, x AS q_higher FROM (
      SELECT fold, method, geo_value, lag, absolute_error_working AS x, count(*) OVER (PARTITION BY fold, method, geo_value, lag) AS n,
             row_number() OVER (PARTITION BY fold, method, geo_value, lag ORDER BY absolute_error_working) AS place
      FROM {history_strata_rows}) t
    WHERE place = 1 + CAST(ceil((n - 1) * 9e-1) AS BIGINT)
""")
model("endpoint_scores", " UNION ALL ".join(
    f"SELECT fold, method, geo_value, lag, '{q}' AS q, {t} AS tau, {f'{q}_working - truth_working' if t in TAUS[:4] else f'truth_working - {q}_working'} AS x, {f'1 - {t}' if t in TAUS[:4] else t} AS level FROM {{history_strata_rows}}"
    for t, q in zip(TAUS, QS) if q != "q0_5"
), public=False)
model("endpoint_offsets", """
    SELECT fold, method, geo_value, lag, q, tau, n, CASE WHEN tau < 5e-1 THEN 0e0 - greatest(x, 0e0) ELSE greatest(x, 0e0) END AS endpoint_offset FROM (
      SELECT *, count(*) OVER (PARTITION BY fold, method, geo_value, lag, q) AS n, row_number() OVER (PARTITION BY fold, method, geo_value, lag, q ORDER BY x) AS place
      FROM {endpoint_scores}) t
    WHERE place = 1 + CAST(ceil((n - 1) * level) AS BIGINT)
""")
_low, _high = list(QS[:4]), list(QS[5:])
model("non_crossing", f"""
    WITH o AS (SELECT fold, method, geo_value, lag, max(n) AS n, {', '.join(f"max(CASE WHEN q = '{q}' THEN endpoint_offset END) AS {q}" for q in QS if q != 'q0_5')} FROM {{endpoint_offsets}} GROUP BY fold, method, geo_value, lag),
    m AS (SELECT {keys('l', 'method', 'truth_working', 'model_available')}, coalesce(o.n, 0) AS n, l.q0_5_working AS q0_5, {', '.join(f'l.{q}_working + coalesce(o.{q}, 0e0) AS {q}' for q in QS if q != 'q0_5')}
          FROM {{long}} l LEFT JOIN o ON {same('o', 'l', STRATUM)})
    SELECT {keys('m', 'method', 'truth_working', 'model_available', 'n')}, q0_5,
           {', '.join(f"least({', '.join([*_low[i:], 'q0_5'])}) AS {q}" for i, q in enumerate(_low))},
           {', '.join(f"greatest({', '.join(['q0_5', *_high[: i + 1]])}) AS {q}" for i, q in enumerate(_high))}
    FROM m
""")
model("prospective_calibration", f"""
    SELECT {keys('c', 'method')}, c.n AS history_n, s.level AS calibration_source, {wis('c.truth_working', '', 'c.')} AS wis_working,
           {', '.join(f'exp(c.{q}) - 1 AS {q}' for q in QS)}
    FROM {{non_crossing}} c JOIN {{history_strata}} s ON {same('s', 'c', STRATUM)}
""")


def _interval(low: str, high: str, level: str, y: str = "y") -> str:
    tolerance = f"1e-9 * greatest(1e0, abs({low}), abs({high}))"
    return f"({y} >= {low} - {tolerance} AND {y} <= {high} + {tolerance}) AS covered_{level}, {high} - {low} AS width_{level}, {y} < {low} - {tolerance} AS missed_low_{level}, {y} > {high} + {tolerance} AS missed_high_{level}"


_INTERVALS = ", ".join(_interval(*x) for x in (("q0_25", "q0_75", "50"), ("q0_1", "q0_9", "80"), ("q0_025", "q0_975", "95")))
model("interval_columns", f"""
    WITH b AS (
      SELECT {keys('l', 'method')}, 'base' AS version, l.truth_working AS y, {', '.join(f'l.{q}_working AS {q}' for q in QS)} FROM {{long}} l WHERE l.has_distribution
      UNION ALL SELECT {keys('c', 'method')}, 'calibrated', c.truth_working, {', '.join(f'c.{q}' for q in QS)} FROM {{non_crossing}} c WHERE c.model_available)
    SELECT {keys('b', 'method', 'version')}, {wis('y')} AS wis_working, {_INTERVALS} FROM b
""")
model("interval_long", " UNION ALL ".join(
    f"SELECT method, version, lag, CAST({level} AS INT) AS level, covered_{level} AS covered, width_{level} AS width, missed_low_{level} AS missed_low, missed_high_{level} AS missed_high, wis_working FROM {{interval_columns}}"
    for level in (50, 80, 95)
), public=False)
_TABLE = """CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN covered THEN 1e0 ELSE 0e0 END) AS coverage, avg(CASE WHEN covered THEN 1e0 ELSE 0e0 END) - level / 1e2 AS coverage_error,
           avg(width) AS mean_width, {pct(width; 5e-1)} AS median_width, avg(CASE WHEN missed_low THEN 1e0 ELSE 0e0 END) AS missed_low, avg(CASE WHEN missed_high THEN 1e0 ELSE 0e0 END) AS missed_high,
           avg(wis_working) AS mean_wis, {pct(wis_working; 5e-1)} AS median_wis"""
model("interval_calibration", f"SELECT method, version, level, {_TABLE} FROM {{interval_long}} GROUP BY method, version, level")
model("interval_calibration_by_lag", f"""
    WITH s AS (
      SELECT 'overall' AS scope, l.* FROM {{interval_long}} l UNION ALL SELECT 'early', l.* FROM {{interval_long}} l WHERE lag <= 14
      UNION ALL SELECT concat('lag=', CAST(lag AS STRING)), l.* FROM {{interval_long}} l)
    SELECT scope, method, version, level, {_TABLE} FROM s GROUP BY scope, method, version, level
""")


def _ecdf(long: DataFrame) -> DataFrame:
    rows = long.where("model_available").withColumn("x", F.round("absolute_error_working", 9))
    group = ["method", "lag"]
    values = stored(order.cumulated(rows.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("n")), group, "x"), "values")
    return order.looked_up(rows, values, [*group, "x"]).select(*KEY, "method", (F.col("upto") / F.col("total")).alias("ecdf"))


frame_model("ecdf_rank", ("long",), _ecdf, sql=f"""
    SELECT {keys('l', 'method')}, CAST(count(*) OVER (PARTITION BY method, lag ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (PARTITION BY method, lag) AS ecdf
    FROM (SELECT *, round(absolute_error_working, 9) AS x FROM {{long}} WHERE model_available) l
""")
_WILSON = "CASE WHEN n > 0 THEN (k / CAST(n AS DOUBLE) + 19207294e-7 / n {sign} 1959964e-6 * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + 9603647e-7 / (n * CAST(n AS DOUBLE)))) / (1 + 38414588e-7 / n) END"
LOW, HIGH = (f"{f}(0e0, {_WILSON.format(sign=s)})" if f == "greatest" else f"{f}(1e0, {_WILSON.format(sign=s)})" for f, s in (("greatest", "-"), ("least", "+")))
model("wilson_interval", f"""
    WITH t AS (SELECT method, geo_value, count(*) AS n, sum(CASE WHEN harm THEN 1 ELSE 0 END) AS k FROM {{scored}} WHERE model_available GROUP BY method, geo_value)
    SELECT method, geo_value, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, {LOW} AS low, {HIGH} AS high FROM t
""")
model("forecast_quality", f"""
    WITH t AS (SELECT fold, method, geo_value, lag, count(*) AS n, sum(CASE WHEN harm THEN 1 ELSE 0 END) AS k FROM {{history_strata_rows}} GROUP BY fold, method, geo_value, lag)
    SELECT s.fold, s.method, s.geo_value, s.lag, s.level, u.q_error, CAST(t.n AS BIGINT) AS n_err, CAST(t.k AS BIGINT) AS k_harm, t.k / CAST(t.n AS DOUBLE) AS f_harm, {LOW} AS f_harm_wilson_low, {HIGH} AS f_harm_wilson_high
    FROM {{history_strata}} s LEFT JOIN t ON {same('t', 's', STRATUM)} LEFT JOIN {{upper_order_statistic}} u ON {same('u', 's', STRATUM)}
""".replace("(k /", "(t.k /").replace("sqrt(k /", "sqrt(t.k /").replace("CAST(n AS", "CAST(t.n AS").replace(" n > 0", " t.n > 0").replace("/ n ", "/ t.n ").replace("- k /", "- t.k /").replace("/ (n *", "/ (t.n *").replace(")) / n +", ")) / t.n +").replace("-7 / n)", "-7 / t.n)"))
model("harm_severity", f"""
    WITH r AS (
      SELECT fold, method, geo_value, lag, regret, count(*) OVER (PARTITION BY fold, method, geo_value, lag) AS n,
             row_number() OVER (PARTITION BY fold, method, geo_value, lag ORDER BY regret) AS place
      FROM {{harm_strata_rows}})
    SELECT s.fold, s.method, s.geo_value, s.lag, s.level, r.regret AS m_harm, coalesce(r.n, 0) AS harm_positive_n
    FROM {{harm_strata}} s LEFT JOIN r ON {same('r', 's', STRATUM)} AND r.place = least(r.n, CAST(ceil((r.n + 1) * 9e-1) AS BIGINT))
""")
model("reliability_history", f"""
    SELECT {keys('s', 'method')}, q.level, q.q_error, q.n_err, q.f_harm, q.k_harm, q.f_harm_wilson_low, q.f_harm_wilson_high, h.m_harm, h.harm_positive_n,
           s.absolute_error_working AS realized_ae, s.null_error AS realized_null_ae, s.regret AS realized_regret, s.harm AS realized_harm,
           s.absolute_error_working <= q.q_error AS qerr_covered, CASE WHEN s.regret > 0 THEN s.regret <= h.m_harm END AS mharm_covered,
           CASE WHEN q.q_error IS NULL THEN 'unavailable' WHEN q.f_harm < 25e-2 THEN 'supported' WHEN q.f_harm < 5e-1 THEN 'caution' ELSE 'high' END AS reliability_level
    FROM {{scored}} s JOIN {{forecast_quality}} q ON {same('q', 's', STRATUM)} JOIN {{harm_severity}} h ON {same('h', 's', STRATUM)}
    WHERE s.model_available
""")
model("reliability_reference", """
    SELECT h.fold, h.method, h.geo_value, h.lag, CAST(count(*) AS BIGINT) AS case_n, {pct(s.absolute_error_working; 9e-1)} AS error_reference, {pct(s.regret; 9e-1)} AS regret_reference
    FROM {history} h JOIN {scored} s ON s.method = h.method AND s.fold = h.from_fold AND s.geo_value = h.geo_value AND s.reference_date = h.reference_date AND s.report_date = h.report_date
    GROUP BY h.fold, h.method, h.geo_value, h.lag
""")
