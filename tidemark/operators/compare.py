"""Comparison of methods: paired differences, bootstrap over reference dates, bins and rank correlations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored
from . import order
from .forecast import same

# every method against the flat line: by its point forecasts, and by its distributions where it has any
model("comparison_pairs", """
    WITH m AS (
      SELECT method, sum(CASE WHEN model_available THEN 1 ELSE 0 END) AS points, sum(CASE WHEN has_distribution THEN 1 ELSE 0 END) AS distributions
      FROM {long} WHERE method <> 'carry_forward' GROUP BY method),
    p AS (SELECT method, 1 AS k, 'point' AS kind FROM m WHERE points > 0 UNION ALL SELECT method, 2, 'distribution' FROM m WHERE distributions > 0)
    SELECT CAST(row_number() OVER (ORDER BY k, method) AS INT) AS place, method, 'carry_forward' AS baseline, kind FROM p
""")
model("paired", f"""
    SELECT a.fold, a.cutoff, a.geo_value, a.reference_date, a.report_date, a.lag, a.method, b.method AS baseline, a.absolute_error, b.absolute_error AS base_error,
           round(a.absolute_error_working - b.absolute_error_working, 9) AS difference, round(a.wis_working - b.wis_working, 9) AS wis_difference
    FROM {{long}} a JOIN {{long}} b ON a.method <> 'carry_forward' AND b.method = 'carry_forward' AND {same('a', 'b')}
    WHERE a.model_available AND b.model_available
""", public=False)
model("cluster_bootstrap", """
    WITH c AS (
      SELECT method, baseline, reference_date, CAST(row_number() OVER (PARTITION BY method, baseline ORDER BY reference_date) AS BIGINT) AS place,
             CAST(count(*) OVER (PARTITION BY method, baseline) AS BIGINT) AS clusters, sum(CAST(difference AS DECIMAL(28, 9))) AS s, count(*) AS n
      FROM {paired} GROUP BY method, baseline, reference_date),
    draws AS (
      SELECT /*+ BROADCAST(r) */ c.method, c.baseline, r.i AS rep, 1 + {hex48(concat('17:', CAST(r.i AS STRING), ':', CAST(c.place AS STRING)))} % c.clusters AS place
      FROM c CROSS JOIN {numbers(1; 500)} r),
    b AS (
      SELECT /*+ MERGE(c) */ d.method, d.baseline, d.rep, CAST(sum(c.s) AS DOUBLE) / sum(c.n) AS mean
      FROM draws d JOIN c ON c.method = d.method AND c.baseline = d.baseline AND c.place = d.place GROUP BY d.method, d.baseline, d.rep)
    SELECT method, baseline, CAST(count(*) AS BIGINT) AS reps, {pct(mean; 25e-3)} AS low, {pct(mean; 975e-3)} AS high,
           avg(CASE WHEN mean < 0 THEN 1e0 ELSE 0e0 END) AS better_probability
    FROM b GROUP BY method, baseline
""")
model("flat_line_comparison", """
    SELECT method, baseline, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE absolute_error < base_error) AS BIGINT) AS better, CAST(count(*) FILTER (WHERE absolute_error > base_error) AS BIGINT) AS worse,
           CAST(count(*) FILTER (WHERE absolute_error = base_error) AS BIGINT) AS tied, CAST(sum(CAST(base_error - absolute_error AS DECIMAL(28, 4))) AS DOUBLE) AS saved, avg(base_error - absolute_error) AS mean_saved, {pct(base_error - absolute_error; 5e-1)} AS median_saved
    FROM {paired} GROUP BY method, baseline
""", digits=3)
model("pairwise_loss", """
    SELECT method, baseline, avg(difference) AS mean_difference, {pct(difference; 5e-1)} AS median_difference, avg(CASE WHEN difference < 0 THEN 1e0 ELSE 0e0 END) AS win,
           avg(CASE WHEN difference = 0 THEN 1e0 ELSE 0e0 END) AS tie, avg(CASE WHEN difference > 0 THEN 1e0 ELSE 0e0 END) AS loss, 0e0 - avg(difference) AS saved
    FROM {paired} GROUP BY method, baseline
""")


def binned(x: str, groups: str, source: str, cuts: tuple[str, ...] = ("2e-1", "4e-1", "6e-1", "8e-1")) -> str:
    """Rows of source with bin: quantile bins of x within groups, edges are distinct exact percentiles and equal ones drop.

    The bin of x is how many inner edges (and the lowest) lie strictly below it, the first bin holding both.
    """
    by = [g.strip() for g in groups.split(",")]
    edges = ["0e0", *cuts]
    e = ", ".join(f"{{pct({x}; {c})}} AS e{i}" for i, c in enumerate(edges))
    # an edge counts once: only if it differs from the edge before
    below = " + ".join(f"CASE WHEN e{i} < {x}{f' AND e{i} <> e{i - 1}' if i else ''} THEN 1 ELSE 0 END" for i in range(len(edges)))
    return f"""SELECT b.*, greatest({below}, 1) - 1 AS bin FROM {source} b JOIN (SELECT {groups}, {e} FROM {source} WHERE {x} IS NOT NULL GROUP BY {groups}) e ON {' AND '.join(f'b.{g} = e.{g}' for g in by)} WHERE {x} IS NOT NULL"""


def binned_by_size(x: str, groups: str, source: str, least: int, most: int, rows: int) -> str:
    """The same with as many bins as a group has times `rows` rows, but no fewer than least and no more than most."""
    by = [g.strip() for g in groups.split(",")]
    counts = range(least, most + 1)
    edge = {(i, k): f"e{k}_{i}" for k in counts for i in range(k)}
    e = ", ".join(f"{{pct({x}; {i / k!r}e0)}} AS {name}" for (i, k), name in edge.items())
    below = lambda k: " + ".join(f"CASE WHEN {edge[i, k]} < {x}{f' AND {edge[i, k]} <> {edge[i - 1, k]}' if i else ''} THEN 1 ELSE 0 END" for i in range(k))
    bins = " ".join(f"WHEN {k} THEN greatest({below(k)}, 1) - 1" for k in counts)
    size = f"greatest({least}, least({most}, CAST(floor(count(*) / {rows}e0) AS INT)))"
    return f"""SELECT b.*, CASE e.bins {bins} END AS bin FROM {source} b JOIN (SELECT {groups}, {size} AS bins, {e} FROM {source} WHERE {x} IS NOT NULL GROUP BY {groups}) e ON {' AND '.join(f'b.{g} = e.{g}' for g in by)} WHERE {x} IS NOT NULL"""


model("quantile_bins", f"""
    WITH s AS (SELECT fold, geo_value, reference_date, report_date, lag, method, abs(true_remaining_revision) AS size FROM {{long}})
    SELECT q.fold, q.geo_value, q.reference_date, q.report_date, q.method, q.size, q.bin FROM ({binned('size', 'method', 's')}) q
""")
model("stratified_differences", f"""
    WITH j AS (
      SELECT p.*, x.process_shift_score AS score FROM {{paired}} p JOIN {{process_shift}} x ON x.cutoff = p.cutoff AND x.geo_value = p.geo_value WHERE x.process_shift_score IS NOT NULL),
    q AS ({binned('score', 'method', 'j')})
    SELECT stratum, level, CAST(count(*) AS BIGINT) AS n, avg(difference) AS mean_difference, avg(CASE WHEN difference < 0 THEN 1e0 ELSE 0e0 END) AS win FROM (
      SELECT 'shift score' AS stratum, bin AS level, difference FROM q UNION ALL SELECT 'lag', lag, difference FROM {{paired}}) u
    GROUP BY stratum, level HAVING count(*) >= 10
""")


def ranks(x: str, groups: str) -> str:
    """Average rank of x within groups."""
    return f"(rank() OVER (PARTITION BY {groups} ORDER BY {x}) + (count(*) OVER (PARTITION BY {groups}, {x}) - 1) / 2e0)"


def _spearman(history: DataFrame) -> DataFrame:
    rows = history.where("q_error IS NOT NULL").select("method", "lag", F.round("q_error", 9).alias("q_error"), F.round("realized_ae", 9).alias("realized_ae"))
    rows = order.ranked(stored(rows, "rows"), ["method", "lag"], {"q_error": "a", "realized_ae": "b"})
    return rows.groupBy("method", "lag").agg(F.count(F.lit(1)).alias("n"), order.correlation("a", "b").alias("rho")).where("n >= 10")


frame_model("spearman", ("reliability_history",), _spearman, sql=f"""
    WITH r AS (
      SELECT method, lag, {ranks('q_error', 'method, lag')} AS a, {ranks('realized_ae', 'method, lag')} AS b
      FROM (SELECT method, lag, round(q_error, 9) AS q_error, round(realized_ae, 9) AS realized_ae FROM {{reliability_history}} WHERE q_error IS NOT NULL) t)
    SELECT method, lag, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS rho
    FROM r GROUP BY method, lag HAVING count(*) >= 10
""")
