"""Linear quantile regression of many models at once.

Rows are packed into blocks of a model's rows, dealt out by range so that a large model lies in many tasks. Each round
is one job: tasks sum what their blocks add to each model's normal equations, for all levels, and the sums of a model,
one row a task, are solved by weighted least squares whose weights bring the check loss about. The first round's plain
sums say which columns are independent. A model's rows never meet in one task; what meets is a sum for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model, model
from ..storage import stored
from .forecast import QS, TAUS, keys

LEVELS = np.array([float(t) for t in TAUS])
#: Rows of a block; rows that a model needs; rounds at most, and the relative gain of loss at each level under which a
#: model is done.
BLOCK, LEAST, ROUNDS, GAIN = 4096, 10, 60, 1e-4
#: Rounds between two looks at whether all models are done.
STRETCH = 5
#: A column depends on those before it if less than this share of its norm is apart from them. Sums of products have
#: half a double's digits, so smaller shares (some programs take 1e-7) cannot be told from roundings.
TOLERANCE = 1e-6
#: Residuals count as at least so much of their standard deviation; a little of each column's square keeps equations sound.
FLOOR, RIDGE = 1e-4, 1e-10
#: Bytes of coefficients up to which they are broadcast to the blocks; beyond that both are shuffled.
BROADCAST = 8_000_000

_BLOCKS = "model string, n long, x binary, y binary"
_STATE = "model string, n long, kept array<int>, floor double, coefficients array<double>, best array<double>, loss array<double>, done boolean"


def independent(gram: np.ndarray, tolerance: float = TOLERANCE) -> list[int]:
    """The first columns, in order, none of which depends on those before it; gram: their sums of products.

    A Cholesky factor grows column by column; one whose remainder is nothing to its norm is left out.
    """
    norms = np.sqrt(np.maximum(np.diag(gram), 0))
    kept: list[int] = []
    factor = np.zeros((0, 0))
    for j in range(len(gram)):
        if norms[j] == 0:
            continue
        row = np.linalg.solve(factor, gram[kept, j] / norms[kept] / norms[j]) if kept else np.zeros(0)
        rest = 1 - row @ row
        if rest > tolerance**2:
            factor = np.block([[factor, np.zeros((len(kept), 1))], [row[None, :], np.array([[np.sqrt(rest)]])]])
            kept.append(j)
    return kept


def _solve(gram: np.ndarray, cross: np.ndarray, kept: list[int]) -> np.ndarray:
    out = np.zeros(len(cross))
    if kept:
        own = gram[np.ix_(kept, kept)]
        scale = np.sqrt(np.maximum(np.diag(own), 1e-300))
        out[kept] = np.linalg.solve(own / scale[:, None] / scale + RIDGE * np.eye(len(kept)), cross[kept] / scale) / scale
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """rows: model string, x array<double>, y double, none of them null."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            names, y = np.array(t["model"].to_pylist(), object), t["y"].to_numpy()
            lists = pa.concat_arrays(t["x"].chunks)
            x = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            cuts = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names))
            own = list(zip(cuts, cuts[1:]))
            return pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in own]), pa.array([int(b - a) for a, b in own]), pa.array([x[ends[a] : ends[b]].tobytes() for a, b in own], pa.binary()), pa.array([y[a:b].tobytes() for a, b in own], pa.binary())], ["model", "n", "x", "y"])

        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                held.append(part)
                size += len(part)
                if size >= BLOCK:
                    yield packed()
                    held.clear()
                    size = 0
        if held:
            yield packed()

    dealt = rows.select("model", "x", "y").repartitionByRange(n, "model", F.xxhash64("x", "y")).sortWithinPartitions("model")
    return stored(dealt.mapInArrow(run, _BLOCKS), "blocks")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's blocks add to their models' equations: without coefficients the plain sums, else those of each level."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        first = "coefficients" not in b.schema.names
        for i in range(len(b)):
            name, n = b["model"][i].as_py(), b["n"][i].as_py()
            y = np.frombuffer(b["y"][i].as_py())
            x = np.frombuffer(b["x"][i].as_py()).reshape(n, -1)
            if first:
                own = np.concatenate([[n, y @ y], x.T @ y, (x.T @ x).ravel()])
            else:
                beta, floor = np.array(b["coefficients"][i].as_py()).reshape(len(LEVELS), -1), b["floor"][i].as_py()
                r = y[:, None] - x @ beta.T
                slope = np.where(r > 0, LEVELS, 1 - LEVELS)
                w = slope / np.maximum(np.abs(r), floor)
                parts = [(slope * np.abs(r)).sum(axis=0)]
                for k in range(len(LEVELS)):
                    xw = x * w[:, k : k + 1]
                    parts += [xw.T @ y, (xw.T @ x).ravel()]
                own = np.concatenate(parts)
            total[name] = total[name] + own if name in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["model", "sums"])


def _width(size: int, levels: int) -> int:
    """Columns of a model whose sums are so many numbers."""
    return int((-1 + np.sqrt(1 + 4 * (size - (2 if levels == 1 else levels)) / levels)) / 2 + 0.5)


def _total(lists: pa.Array) -> list[np.ndarray]:
    return [np.sum([np.frombuffer(x) for x in own], axis=0) for own in lists.to_pylist()]


def _states(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], [c.split()[0] for c in _STATE.split(", ")])


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for name, s in zip(b["model"].to_pylist(), _total(b["sums"])):
            p = _width(len(s), 1)
            n, yy, cross, gram = int(s[0]), s[1], s[2 : 2 + p], s[2 + p :].reshape(p, p)
            kept = independent(gram)
            beta = _solve(gram, cross, kept)
            deviation = np.sqrt(max(yy - beta @ cross, 0) / max(n, 1))
            same = np.tile(beta, len(LEVELS)).tolist()
            rows.append((name, n, kept, max(FLOOR * deviation, 1e-12), same, same, [float("inf")] * len(LEVELS), n < LEAST))
        yield _states(rows)


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for old, s in zip(b.drop_columns(["sums"]).to_pylist(), _total(b["sums"])):
            k, p = len(LEVELS), _width(len(s), len(LEVELS))
            used, best, before, loss = np.array(old["coefficients"]).reshape(k, p), np.array(old["best"]).reshape(k, p), np.array(old["loss"]), s[:k]
            best[loss < before] = used[loss < before]
            new = [_solve(e[p:].reshape(p, p), e[:p], old["kept"]) for e in s[k:].reshape(k, p + p * p)]
            least = np.minimum(loss, before)
            done = bool(np.all(before - loss <= GAIN * np.maximum(least, 1e-300)))  # what is infinite at first is a gain
            rows.append((old["model"], old["n"], old["kept"], old["floor"], np.ravel(new).tolist(), best.ravel().tolist(), least.tolist(), done))
        yield _states(rows)


def _gathered(sums: DataFrame) -> DataFrame:
    """A row for each model: the sums of all tasks, one of each."""
    return sums.groupBy("model").agg(F.collect_list("sums").alias("sums"))


def start(packed: DataFrame) -> DataFrame:
    """The state of each model before the first round: independent columns and least squares."""
    return stored(_gathered(packed.mapInArrow(_sums, "model string, sums binary")).mapInArrow(_start, _STATE), "fit")


def fit(packed: DataFrame, state: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """model, n, kept, best: for each level the coefficients of the least loss that was met, level by level."""
    size = state.agg(F.coalesce(F.sum(F.size("coefficients") * 8), F.lit(0))).first()[0]
    for k in range(rounds):
        if k % STRETCH == 0 and state.where("NOT done").isEmpty():
            break
        going = state.where("NOT done")
        known = going.select("model", "floor", "coefficients")
        joined = packed.join(F.broadcast(known) if size <= BROADCAST else known.hint("merge"), "model")
        sums = joined.select("model", "n", "x", "y", "floor", "coefficients").mapInArrow(_sums, "model string, sums binary")
        new = going.join(_gathered(sums).hint("merge"), "model").mapInArrow(_step, _STATE)
        state = stored(new.unionByName(state.where("done")), "fit")
    return state.where(F.col("n") >= LEAST).select("model", "n", "kept", "best")


def predicted(test: DataFrame, fitted: DataFrame) -> DataFrame:
    """test (model, x, ...) with quantiles, an array in order; rows whose model was not fitted are left out."""
    p = F.expr(f"transform(sequence(0, {len(LEVELS) - 1}), i -> aggregate(zip_with(slice(best, i * size(x) + 1, size(x)), x, (b, v) -> b * v), 0D, (s, v) -> s + v))")
    return test.join(fitted.select("model", "best").hint("merge"), "model").withColumn("quantiles", F.array_sort(p)).drop("best")


# what a fit may know of a case or a row: a constant, the latest value, its last revision, the stage, the weekday
_X = "array(1D, CAST({a}.latest AS DOUBLE), {a}.log_delta_value_7dav_lag7, {a}.inv_log_lag, CAST({a}.mon_issue AS DOUBLE))"
_COMPLETE = "{a}.latest IS NOT NULL AND {a}.log_delta_value_7dav_lag7 IS NOT NULL AND {a}.inv_log_lag IS NOT NULL AND {a}.mon_issue IS NOT NULL"
model("training_features", """
    SELECT t.fold, t.geo_value, t.reference_date, t.report_date, t.lag, t.latest, t.remaining, d.log_delta_value_7dav_lag7, d.inv_log_lag, d.mon_issue
    FROM {completed_training} t JOIN {triangle} d ON d.geo_value = t.geo_value AND d.reference_date = t.reference_date AND d.report_date = t.report_date AND d.lag = t.lag
    WHERE t.strict AND t.remaining IS NOT NULL
""", public=False)


def _indicators(rows: DataFrame, places: DataFrame, x: str) -> DataFrame:
    """x and a mark for each location but the first; a location that was not trained on has none."""
    return rows.join(places.hint("merge"), "geo_value", "left").withColumn("x", F.expr(f"concat({x}, transform(sequence(2, greatest(2, n_places)), i -> CASE WHEN i = coalesce(place, 1) THEN 1D ELSE 0D END))"))


def _rows(training: DataFrame, groups: DataFrame) -> DataFrame:
    """Training rows of each origin and lag group, by location and of all locations."""
    near = training.where(_COMPLETE.format(a="t").replace("t.", "")).join(F.broadcast(groups), F.expr("lag BETWEEN lo - 1 AND hi + 1"))
    x = _X.format(a="t").replace("t.", "")
    local = near.select(F.expr("concat_ws('|', 'local', fold, lag_group, geo_value)").alias("model"), F.expr(x).alias("x"), F.col("remaining").alias("y"))
    whole = _indicators(near, _places(training), x).select(F.expr("concat_ws('|', 'global', fold, lag_group)").alias("model"), "x", F.col("remaining").alias("y"))
    return local.unionByName(whole)


def _places(training: DataFrame) -> DataFrame:
    found = training.select("geo_value").distinct()
    return found.selectExpr("geo_value", "CAST(row_number() OVER (ORDER BY geo_value) AS INT) AS place", "CAST(count(*) OVER () AS INT) AS n_places")


def _cases(cases: DataFrame, groups: DataFrame, training: DataFrame) -> DataFrame:
    x = _X.format(a="t").replace("t.", "")
    tested = cases.join(F.broadcast(groups), F.expr("lag BETWEEN lo AND hi"))
    many = _places(training).agg(F.max("n_places").alias("n_places"))
    local = tested.withColumn("model", F.expr("concat_ws('|', 'local', fold, lag_group, geo_value)")).withColumn("x", F.expr(x)).withColumn("method", F.lit("quantile_local"))
    placed = _places(training).drop("n_places")
    whole = _indicators(tested.crossJoin(F.broadcast(many)), placed, x).withColumn("model", F.expr("concat_ws('|', 'global', fold, lag_group)")).withColumn("method", F.lit("quantile_global"))
    return local.unionByName(whole.select(local.columns))


def _quantile_fit(packed: DataFrame, state: DataFrame, cases: DataFrame, groups: DataFrame, training: DataFrame) -> DataFrame:
    """Forecasts of each complete case by the fits of its location and of all locations: case, method, prediction, the nine quantiles."""
    fitted = stored(fit(packed, state), "fitted")
    found = predicted(_cases(cases, groups, training), fitted)
    return found.select(*keys("t").replace("t.", "").split(", "), "method", *(F.expr(f"latest + quantiles[{i}]").alias(q) for i, q in enumerate(QS))).withColumn("prediction", F.col("q0_5"))


frame_model("fit_blocks", ("training_features", "lag_groups"), lambda training, groups: blocks(_rows(training, groups)), public=False, digits=None)
frame_model("fit_start", ("fit_blocks",), start, public=False, digits=None)
# which columns each model keeps: numbers of columns as in x, in order
frame_model("independent_columns", ("fit_start",), lambda state: state.select("model", "n", F.expr("size(coefficients) DIV 9").alias("columns"), F.array_join("kept", ",").alias("kept")))
frame_model("quantile_fit", ("fit_blocks", "fit_start", "complete_test_rows", "lag_groups", "training_features"), _quantile_fit)
