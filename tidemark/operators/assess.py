"""Assessment tables over reliability records and long predictions."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored
from . import order
from .compare import binned, binned_by_size, ranks
from .forecast import QS, TAUS, keys, same

_YES = "avg(CASE WHEN {} THEN 1e0 ELSE 0e0 END)"


def yes(condition: str) -> str:
    return _YES.format(condition)


model("evaluation_scopes", f"""
    SELECT 'overall' AS scope, {keys('r', 'method')} FROM {{reliability_history}} r UNION ALL SELECT 'early', {keys('r', 'method')} FROM {{reliability_history}} r WHERE lag <= 14
    UNION ALL SELECT concat('lag=', CAST(lag AS STRING)), {keys('r', 'method')} FROM {{reliability_history}} r
""")
model("scoped", """
    SELECT 'overall' AS scope, r.* FROM {reliability_rows} r UNION ALL SELECT 'early' AS scope, r.* FROM {reliability_rows} r WHERE lag <= 14
""", public=False)
model("reliability_raw", f"""
    SELECT {keys('r', 'method')}, r.level, r.reliability_level, r.q_error, r.f_harm, r.f_harm_wilson_high - r.f_harm_wilson_low AS wilson_width, r.m_harm,
           r.realized_ae, r.realized_regret, CASE WHEN r.realized_harm THEN 1e0 ELSE 0e0 END AS harm, r.qerr_covered, r.mharm_covered,
           l.wis_working, l.q0_975_working - l.q0_025_working AS width, p.process_shift_score AS score, p.process_state, p.process_shift_driver
    FROM {{reliability_history}} r JOIN {{long}} l ON l.method = r.method AND {same('l', 'r')}
    LEFT JOIN {{process_shift}} p ON p.cutoff = r.cutoff AND p.geo_value = r.geo_value
""", public=False)
# doubles to nine digits, so that ties are ties whatever the order of sums
_ROUNDED = ("q_error", "f_harm", "m_harm", "realized_ae", "realized_regret", "width")
model("reliability_rows", f"""
    SELECT {keys('r', 'method', 'level', 'reliability_level')}, {', '.join(f'round(r.{c}, 9) AS {c}' for c in _ROUNDED)}, r.wilson_width, r.harm, r.qerr_covered, r.mharm_covered,
           r.wis_working, r.score, r.process_state, r.process_shift_driver
    FROM {{reliability_raw}} r
""", public=False)
model("reliability_coverage", f"""
    WITH s AS (SELECT * FROM {{scoped}} UNION ALL SELECT concat('lag=', CAST(lag AS STRING)) AS scope, r.* FROM {{reliability_rows}} r)
    SELECT scope, method, CAST(count(*) AS BIGINT) AS n, {yes('qerr_covered')} AS coverage, {yes('qerr_covered')} - 9e-1 AS gap, avg(q_error) AS mean_q_error, avg(realized_ae) AS mean_ae, avg(harm) AS harm_frequency,
           {yes('m_harm IS NOT NULL')} AS severity_available
    FROM s WHERE q_error IS NOT NULL GROUP BY scope, method
""")
model("profile_availability", """
    SELECT scope, method, reliability_level, CAST(count(*) AS BIGINT) AS n, avg(realized_ae) AS mean_ae, {pct(realized_ae; 5e-1)} AS median_ae, {pct(realized_ae; 9e-1)} AS p90_ae, avg(wis_working) AS mean_wis,
           {pct(wis_working; 5e-1)} AS median_wis, {pct(wis_working; 9e-1)} AS p90_wis, avg(realized_regret) AS mean_regret, {pct(realized_regret; 5e-1)} AS median_regret, {pct(realized_regret; 9e-1)} AS p90_regret
    FROM {scoped} GROUP BY scope, method, reliability_level
""")
model("qerr_bins", f"""
    WITH s AS (SELECT * FROM {{scoped}} WHERE q_error IS NOT NULL)
    {binned('q_error', 'scope, method', 's')}
""", public=False)


def _qerr_discrimination(bins: DataFrame) -> DataFrame:
    group = ["scope", "method"]
    rows = order.ranked(bins.select(*group, "q_error", "realized_ae"), group, {"q_error": "a", "realized_ae": "b"})
    found = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), order.correlation("a", "b").alias("spearman")).where("_n >= 10").drop("_n")
    own = bins.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("q_error").alias("mean_q_error"), F.avg("realized_ae").alias("mean_ae"), F.avg("realized_regret").alias("mean_regret"), F.avg("harm").alias("harm_frequency"))
    return own.join(found.hint("merge"), group, "left")


frame_model("qerr_discrimination", ("qerr_bins",), _qerr_discrimination, sql=f"""
    WITH r AS (SELECT scope, method, {ranks('q_error', 'scope, method')} AS a, {ranks('realized_ae', 'scope, method')} AS b FROM {{qerr_bins}}),
    c AS (SELECT scope, method, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS spearman FROM r GROUP BY scope, method HAVING count(*) >= 10 AND count(DISTINCT a) > 1 AND count(DISTINCT b) > 1)
    SELECT q.scope, q.method, q.bin, CAST(count(*) AS BIGINT) AS n, avg(q.q_error) AS mean_q_error, avg(q.realized_ae) AS mean_ae, avg(q.realized_regret) AS mean_regret, avg(q.harm) AS harm_frequency, max(c.spearman) AS spearman
    FROM {{qerr_bins}} q LEFT JOIN c ON c.scope = q.scope AND c.method = q.method GROUP BY q.scope, q.method, q.bin
""")
model("fharm_discrimination", f"""
    WITH s AS (SELECT * FROM {{scoped}} WHERE f_harm IS NOT NULL), q AS ({binned('f_harm', 'scope, method', 's')}),
    o AS (SELECT scope, method, cutoff, avg(harm) AS rate FROM s GROUP BY scope, method, cutoff),
    d AS (SELECT scope, method, max(rate) - min(rate) AS drift FROM o GROUP BY scope, method HAVING count(*) > 2)
    SELECT q.scope, q.method, q.bin, CAST(count(*) AS BIGINT) AS n, avg(q.f_harm) AS mean_f_harm, avg(q.harm) AS harm_frequency, avg(q.wilson_width) AS mean_wilson_width, max(d.drift) AS drift
    FROM q LEFT JOIN d ON d.scope = q.scope AND d.method = q.method GROUP BY q.scope, q.method, q.bin
""")
# of cases that were harmed: whether what was issued covers the harm, and whether more was issued where it was greater
model("harmed", """
    SELECT scope, method, fold, geo_value, reference_date, report_date, m_harm, realized_regret, mharm_covered FROM {scoped} WHERE m_harm IS NOT NULL AND realized_regret > 0
""", public=False)
model("harm_bins", f"""
    WITH s AS (SELECT * FROM {{harmed}}), q AS ({binned_by_size('m_harm', 'scope, method', 's', 2, 5, 20)})
    SELECT scope, method, bin, avg(realized_regret) AS regret, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY scope, method, bin
""", public=False)
model("harm_trend", """
    WITH m AS (SELECT *, lag(regret) OVER (PARTITION BY scope, method ORDER BY bin) AS previous FROM {harm_bins})
    SELECT scope, method, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS bins, min_by(regret, bin) AS lowest, max_by(regret, bin) AS highest, count(*) > 1 AND count(*) FILTER (WHERE regret < previous) = 0 AS monotone
    FROM m GROUP BY scope, method HAVING sum(n) >= 10
""", public=False)


def _severity(harmed: DataFrame, trend: DataFrame) -> DataFrame:
    group = ["scope", "method"]
    rows = order.ranked(harmed.select(*group, "m_harm", "realized_regret", "mharm_covered"), group, {"m_harm": "a", "realized_regret": "b"})
    found = rows.groupBy(*group).agg(F.avg(F.when(F.col("mharm_covered"), 1.0).otherwise(0.0)).alias("coverage"), order.correlation("a", "b").alias("spearman"))
    return trend.join(found.hint("merge"), group)


frame_model("mharm_severity", ("harmed", "harm_trend"), _severity, sql=f"""
    WITH r AS (SELECT scope, method, mharm_covered, {ranks('m_harm', 'scope, method')} AS x, {ranks('realized_regret', 'scope, method')} AS y FROM {{harmed}}),
    c AS (SELECT scope, method, {yes('mharm_covered')} AS coverage, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS spearman FROM r GROUP BY scope, method)
    SELECT t.*, c.coverage, c.spearman FROM {{harm_trend}} t JOIN c ON c.scope = t.scope AND c.method = t.method
""")
# whether q_error tells errors apart where intervals are as wide: thirds of width, thirds of q_error within; 40 rows in all, 20 in a band
model("width_bands", f"""
    WITH s AS (SELECT * FROM {{scoped}} WHERE q_error IS NOT NULL AND width IS NOT NULL AND realized_ae IS NOT NULL),
    n AS (SELECT scope FROM s GROUP BY scope HAVING count(*) >= 40),
    k AS (SELECT s.scope, s.method, s.fold, s.geo_value, s.reference_date, s.report_date, s.q_error, s.realized_ae, s.width FROM s JOIN n ON n.scope = s.scope)
    SELECT x.*, x.bin AS band FROM ({binned('width', 'scope, method', 'k', ('3333333333333333e-16', '6666666666666666e-16'))}) x
""", public=False)
model("width_thirds", f"""
    WITH v AS (SELECT scope, method, band, q_error, realized_ae, width FROM {{width_bands}}),
    q AS ({binned('q_error', 'scope, method, band', 'v', ('3333333333333333e-16', '6666666666666666e-16'))}),
    b AS (SELECT scope, method, band, bin, avg(realized_ae) AS ae, count(*) AS n, sum(width) AS width FROM q GROUP BY scope, method, band, bin)
    SELECT scope, method, band, CAST(sum(n) AS BIGINT) AS n, sum(width) / sum(n) AS mean_width, min_by(ae, bin) AS lowest, max_by(ae, bin) AS highest,
           CASE WHEN min_by(ae, bin) > 0 THEN max_by(ae, bin) / min_by(ae, bin) END AS ratio, max_by(ae, bin) > min_by(ae, bin) AS stratifies
    FROM b GROUP BY scope, method, band HAVING sum(n) >= 20 AND count(*) >= 2
""", public=False)


def _by_width(bands: DataFrame, thirds: DataFrame) -> DataFrame:
    group = ["scope", "method"]
    rows = stored(bands.select(*group, "band", "q_error", "realized_ae", "width"), "rows")
    whole = order.ranked(rows.select(*group, "q_error", "width"), group, {"q_error": "a", "width": "b"}).groupBy(*group).agg(order.correlation("a", "b").alias("spearman_width"))
    inner = order.ranked(rows.select(*group, "band", "q_error", "realized_ae"), [*group, "band"], {"q_error": "a", "realized_ae": "b"}).groupBy(*group, "band").agg(order.correlation("a", "b").alias("spearman_within"))
    return thirds.join(whole.hint("merge"), group).join(inner.hint("merge"), [*group, "band"])


_RHO = "CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END"
frame_model("qerr_vs_width", ("width_bands", "width_thirds"), _by_width, sql=f"""
    WITH r AS (SELECT scope, method, {ranks('q_error', 'scope, method')} AS x, {ranks('width', 'scope, method')} AS y FROM {{width_bands}}),
    w AS (SELECT scope, method, {_RHO} AS spearman_width FROM r GROUP BY scope, method),
    i AS (SELECT scope, method, band, {ranks('q_error', 'scope, method, band')} AS x, {ranks('realized_ae', 'scope, method, band')} AS y FROM {{width_bands}}),
    v AS (SELECT scope, method, band, {_RHO} AS spearman_within FROM i GROUP BY scope, method, band)
    SELECT t.*, w.spearman_width, v.spearman_within FROM {{width_thirds}} t JOIN w ON w.scope = t.scope AND w.method = t.method JOIN v ON v.scope = t.scope AND v.method = t.method AND v.band = t.band
""")
_OPPOSED = (("q_error", "realized_ae", "qerr_ae"), ("q_error", "realized_regret", "qerr_regret"), ("q_error", "harm", "qerr_harm"), ("f_harm", "harm", "fharm_harm"))


def _opposed(scoped: DataFrame) -> DataFrame:
    columns = {c: f"r_{c}" for c in ("q_error", "f_harm", "realized_ae", "realized_regret", "harm")}
    rows = stored(scoped.where("q_error IS NOT NULL AND f_harm IS NOT NULL").select("scope", "method", *columns), "rows")
    ranks = order.ranked(rows, ["scope", "method"], columns)
    return ranks.groupBy("scope", "method").agg(F.count(F.lit(1)).alias("n"), *(order.correlation(columns[a], columns[b]).alias(n) for a, b, n in _OPPOSED))


frame_model("opposed_objectives", ("scoped",), _opposed, sql=f"""
    WITH s AS (SELECT * FROM {{scoped}} WHERE q_error IS NOT NULL AND f_harm IS NOT NULL),
    r AS (SELECT scope, method, {', '.join(f"{ranks(c, 'scope, method')} AS r_{c}" for c in ('q_error', 'f_harm', 'realized_ae', 'realized_regret', 'harm'))} FROM s)
    SELECT scope, method, CAST(count(*) AS BIGINT) AS n, {', '.join(f"CASE WHEN count(DISTINCT r_{a}) > 1 AND count(DISTINCT r_{b}) > 1 THEN covar_pop(r_{a}, r_{b}) / nullif(stddev_pop(r_{a}) * stddev_pop(r_{b}), 0) END AS {n}" for a, b, n in _OPPOSED)}
    FROM r GROUP BY scope, method
""")
model("monitor_nondegeneracy", f"""
    WITH m AS (SELECT max(process_shift_score) AS top FROM {{process_shift}})
    SELECT {{pct(process_shift_score; 25e-2)}} AS q25, {{pct(process_shift_score; 5e-1)}} AS median, {{pct(process_shift_score; 75e-2)}} AS q75, CAST(count(DISTINCT process_shift_score) AS BIGINT) AS distinct_scores,
           {yes('process_shift_score = top')} AS share_at_max, {yes('process_shift_score IS NULL')} AS unavailable, {yes("process_state = 'stable'")} AS stable, {yes("process_state = 'watch'")} AS watch, {yes("process_state = 're-diagnose'")} AS re_diagnose,
           CASE WHEN count(DISTINCT process_shift_score) <= 1 OR {yes('process_shift_score = top')} > 5e-1 THEN 'degenerate' ELSE 'informative' END AS verdict
    FROM {{process_shift}} CROSS JOIN m
""")
model("process_alert_validation", """
    SELECT scope, method, process_state, CAST(count(*) AS BIGINT) AS n, avg(realized_ae) AS mean_ae, avg(realized_regret) AS mean_regret, avg(score) AS mean_score
    FROM {scoped} WHERE process_state <> 'insufficient-history' GROUP BY scope, method, process_state
""")
model("process_attribution", """
    SELECT method, process_state, process_shift_driver, CAST(count(*) AS BIGINT) AS n, avg(score) AS mean_score FROM {reliability_rows} WHERE process_shift_driver IS NOT NULL GROUP BY method, process_state, process_shift_driver
""")
_QUARTERS = ("25e-2", "5e-1", "75e-2")
for _name, _x, _out in (("difficulty_vs_process", "q_error", "avg(q_error) AS mean_q_error, avg(score) AS mean_score, avg(realized_ae) AS mean_ae, {pct(realized_ae; 5e-1)} AS median_ae"), ("harm_vs_process", "f_harm", "avg(harm) AS harm_frequency, CAST(sum(harm) AS BIGINT) AS harmful")):
    model(_name, f"""
        WITH s AS (SELECT * FROM {{reliability_rows}} WHERE {_x} IS NOT NULL AND score IS NOT NULL), a AS ({binned(_x, 'method', 's', _QUARTERS)}), d AS (SELECT method, fold, geo_value, reference_date, report_date, q_error, f_harm, score, realized_ae, harm, bin AS risk_bin FROM a), b AS ({binned('score', 'method', 'd', _QUARTERS)})
        SELECT method, risk_bin, bin AS shift_bin, CAST(count(*) AS BIGINT) AS n, {_out} FROM b GROUP BY method, risk_bin, bin
    """)
model("process_context_join", f"SELECT {keys('r', 'method')}, r.q_error, r.realized_ae, r.score, r.process_state FROM {{reliability_raw}} r")
model("alignment_rows", f"SELECT {keys('r', 'method')}, r.q_error, r.f_harm, r.m_harm, r.score, r.realized_ae, r.realized_regret, r.harm FROM {{reliability_raw}} r WHERE r.q_error IS NOT NULL")
model("alert_confusion", """
    WITH t AS (
      SELECT scope, method, CAST(count(*) FILTER (WHERE alert AND bad) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE alert AND NOT bad) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT alert AND bad) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT alert AND NOT bad) AS BIGINT) AS tn
      FROM (SELECT scope, method, reliability_level IN ('high', 'caution') AS alert, realized_regret > 0 AS bad FROM {scoped} WHERE reliability_level <> 'unavailable') u GROUP BY scope, method)
    SELECT *, tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS sensitivity, tn / CAST(nullif(tn + fp, 0) AS DOUBLE) AS specificity, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS ppv, tn / CAST(nullif(tn + fn, 0) AS DOUBLE) AS npv, fp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS false_alert_rate FROM t
""")
model("joint_alert_grid", """
    SELECT scope, method, reliability_level, process_state, CAST(count(*) AS BIGINT) AS n, avg(realized_ae) AS mean_ae, avg(harm) AS harm_frequency FROM {scoped} GROUP BY scope, method, reliability_level, process_state
""")
model("dual_alert_contrasts", """
    WITH c AS (SELECT method, reliability_level, reference_date, CAST(row_number() OVER (PARTITION BY method, reliability_level ORDER BY reference_date) AS BIGINT) AS place, CAST(count(*) OVER (PARTITION BY method, reliability_level) AS BIGINT) AS clusters, sum(CAST(realized_ae AS DECIMAL(28, 9))) AS s, count(*) AS n
      FROM {reliability_rows} WHERE reliability_level <> 'unavailable' GROUP BY method, reliability_level, reference_date),
    d AS (SELECT k.method, k.reliability_level, r.i AS rep, 1 + {hex48(concat(k.reliability_level, ':', CAST(r.i AS STRING), ':', CAST(s.place AS STRING)))} % k.clusters AS place
      FROM (SELECT DISTINCT method, reliability_level, clusters FROM c) k CROSS JOIN {numbers(1; 500)} r JOIN c s ON s.method = k.method AND s.reliability_level = k.reliability_level),
    b AS (SELECT d.method, d.reliability_level, d.rep, CAST(sum(c.s) AS DOUBLE) / sum(c.n) AS ae FROM d JOIN c ON c.method = d.method AND c.reliability_level = d.reliability_level AND c.place = d.place GROUP BY d.method, d.reliability_level, d.rep),
    x AS (SELECT h.method, h.reliability_level AS higher, l.reliability_level AS lower, h.ae - l.ae AS difference FROM b h JOIN b l ON h.method = l.method AND h.rep = l.rep AND (h.reliability_level = 'high' AND l.reliability_level = 'caution' OR h.reliability_level = 'caution' AND l.reliability_level = 'supported'))
    SELECT method, higher, lower, avg(difference) AS mean_difference, {pct(difference; 25e-3)} AS low, {pct(difference; 975e-3)} AS high FROM x GROUP BY method, higher, lower
""")

# -- accuracy ------------------------------------------------------------------------------------------------
model("matched", f"SELECT l.* FROM {{long}} l {{semi(x)}} (SELECT * FROM {{matched_cases}}) m ON m.method = l.method AND {same('m', 'l')}", public=False)


def _accuracy(error: str, matched: DataFrame) -> DataFrame:
    rows = matched.select("method", error)
    own = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_ae"))
    own = own.join(order.percentiles(rows, ["method"], error, {"median_ae": 0.5, "p90_ae": 0.9}).hint("merge"), "method", "left")
    flat = own.where("method = 'carry_forward'").select(F.col("mean_ae").alias("_flat"))
    return own.crossJoin(F.broadcast(flat)).select("method", "n", "mean_ae", "median_ae", "p90_ae", (100 * (1 - F.col("mean_ae") / F.col("_flat"))).alias("gain_percent"))


for _name, _e in (("accuracy_overall", "absolute_error"), ("accuracy_working", "absolute_error_working")):
    frame_model(_name, ("matched",), partial(_accuracy, _e), sql=f"""
        WITH t AS (SELECT method, CAST(count(*) AS BIGINT) AS n, avg({_e}) AS mean_ae, {{pct({_e}; 5e-1)}} AS median_ae, {{pct({_e}; 9e-1)}} AS p90_ae FROM {{matched}} GROUP BY method)
        SELECT t.*, 1e2 * (1 - t.mean_ae / b.mean_ae) AS gain_percent FROM t CROSS JOIN (SELECT mean_ae FROM t WHERE method = 'carry_forward') b
    """)
model("method_availability", "SELECT method, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE model_available) AS BIGINT) AS available, CAST(count(*) FILTER (WHERE has_distribution) AS BIGINT) AS probabilistic FROM {long} GROUP BY method")
_ERRORS = ", ".join(f"avg({c}) AS mean_{c}, {{pct({c}; 5e-1)}} AS median_{c}" for c in ("absolute_error", "absolute_error_working", "wis", "wis_working"))
model("accuracy_by_lag", f"SELECT lag, method, CAST(count(*) AS BIGINT) AS n, {_ERRORS} FROM {{matched}} GROUP BY lag, method")
model("accuracy_by_origin", "SELECT cutoff, method, CAST(count(*) AS BIGINT) AS n, avg(absolute_error) AS mean_ae FROM {matched} GROUP BY cutoff, method")
model("accuracy_by_location", "SELECT geo_value, method, CAST(count(*) AS BIGINT) AS n, avg(absolute_error) AS mean_ae FROM {matched} WHERE lag <= 14 GROUP BY geo_value, method")
model("distribution_summary", f"""
    SELECT method, avg(wis) AS mean_wis, {', '.join(f"{yes(f'truth >= {a} AND truth <= {b}')} AS coverage_{n}, avg({b} - {a}) AS width_{n}, {yes(f'truth < {a}')} AS missed_low_{n}, {yes(f'truth > {b}')} AS missed_high_{n}" for a, b, n in (('q0_25', 'q0_75', 50), ('q0_1', 'q0_9', 80), ('q0_025', 'q0_975', 95)))}
    FROM {{matched}} WHERE has_distribution GROUP BY method
""")
model("quantile_calibration", " UNION ALL ".join(f"SELECT method, {t} AS tau, {yes(f'truth_working <= {q}_working + 1e-9')} AS empirical FROM {{matched}} WHERE has_distribution GROUP BY method" for t, q in zip(TAUS, QS)))
model("accuracy_by_revision_size", f"""
    WITH s AS (SELECT method, fold, geo_value, reference_date, report_date, absolute_error, round(abs(true_remaining_revision), 9) AS size FROM {{matched}})
    SELECT method, bin, CAST(count(*) AS BIGINT) AS n, avg(size) AS mean_size, avg(absolute_error) AS mean_ae FROM ({binned('size', 'method', 's')}) q GROUP BY method, bin
""")
model("process_audit", """
    SELECT method, process_state, CAST(count(*) AS BIGINT) AS n, avg(realized_ae) AS mean_ae, avg(score) AS mean_score FROM {reliability_rows} GROUP BY method, process_state
""")
model("risk_group_validation", "SELECT method, reliability_level, CAST(count(*) AS BIGINT) AS n, avg(realized_ae) AS mean_ae, avg(harm) AS harm_frequency FROM {reliability_rows} GROUP BY method, reliability_level")
model("sink_tables", """
    SELECT p.method, p.fold, CAST(p.n AS BIGINT) AS n, p.mean_ae, CAST(r.records AS BIGINT) AS records
    FROM (SELECT method, fold, count(*) AS n, avg(absolute_error_working) AS mean_ae FROM {long} GROUP BY method, fold) p
    LEFT JOIN (SELECT method, fold, count(*) AS records FROM {reliability_history} GROUP BY method, fold) r ON r.method = p.method AND r.fold = p.fold
""")
