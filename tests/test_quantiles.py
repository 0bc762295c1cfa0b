"""Quantile regression against exact optima, planted columns, and methods that enter the long table."""

import itertools

import numpy as np
import pytest

from tidemark.models import run
from tidemark.operators import methods, quantiles

SF = "/root/testdata/sf0.001"


def loss(y, x, beta, tau):
    r = y - x @ beta
    return np.where(r > 0, tau * r, (tau - 1) * r).sum()


def rows(spark, sets):
    return spark.createDataFrame([(m, [float(v) for v in a], float(b)) for m, (x, y) in sets.items() for a, b in zip(x, y)], "model string, x array<double>, y double").repartition(3)


def test_columns_that_depend_on_earlier_ones_are_left_out():
    r = np.random.default_rng(1)
    a, b, c = r.normal(size=(3, 200))
    x = np.stack([np.ones(200), a, 2 * a - 3, np.zeros(200), b, a + b, 3 + 0.5 * c, c], axis=1)
    assert quantiles.independent(x.T @ x) == [0, 1, 4, 6]
    day = r.integers(0, 2, 200)
    x = np.stack([np.ones(200), day, 1 - day, a], axis=1)
    assert quantiles.independent(x.T @ x) == [0, 1, 3] and quantiles.independent(x[:, ::-1].T @ x[:, ::-1]) == [0, 1, 2]


def test_losses_are_near_the_optimum(spark, monkeypatch):
    """With two columns an optimum passes through two points, so all pairs are tried."""
    monkeypatch.setattr(quantiles, "BLOCK", 16)  # a model in many blocks
    r = np.random.default_rng(7)
    sets = {}
    for m in range(6):
        n = 60 + 8 * m
        z = r.normal(size=n)
        sets[f"m{m}"] = (np.stack([np.ones(n), z], axis=1), 1 + m * z + r.standard_t(3, size=n) * (1 + 0.5 * np.abs(z)))
    sets["few"] = (np.ones((9, 2)), np.arange(9))
    sets["constant"] = (np.stack([np.ones(30), np.ones(30)], axis=1), np.full(30, 4.0))
    packed = quantiles.blocks(rows(spark, sets))
    start = quantiles.start(packed)
    assert {x["model"]: x["kept"] for x in start.collect()}["constant"] == [0]
    got = {x["model"]: np.array(x["best"]).reshape(9, -1) for x in quantiles.fit(packed, start).collect()}
    assert set(got) == set(sets) - {"few"}
    assert np.allclose(got["constant"] @ np.ones(2), 4)
    for m in range(6):
        x, y = sets[f"m{m}"]
        for k, tau in enumerate(quantiles.LEVELS):
            pairs = [np.linalg.solve(x[[i, j]], y[[i, j]]) for i, j in itertools.combinations(range(len(y)), 2) if x[i, 1] != x[j, 1]]
            least = min(loss(y, x, b, tau) for b in pairs)
            assert loss(y, x, got[f"m{m}"][k], tau) <= 1.005 * least + 1e-9


def test_quantiles_are_in_order_and_fits_learn_nothing_from_later_reports(spark):
    got = run(spark, "quantile_fit", SF)
    q = [f"q0_{x}" for x in ("01", "025", "1", "25", "5", "75", "9", "975", "99")]
    assert got.where(" OR ".join(f"{a} > {b}" for a, b in zip(q, q[1:]))).isEmpty()
    assert got.groupBy("fold", "geo_value", "reference_date", "report_date", "method").count().where("count > 1").isEmpty()
    share = run(spark, "training_features", SF)
    assert share.join(run(spark, "schedule", SF), "fold").where("report_date >= cutoff").isEmpty()


@pytest.fixture
def added():
    before = dict(methods.METHODS)
    yield
    methods.METHODS.clear()
    methods.METHODS.update(before)


def test_a_method_of_a_user_is_scored(spark, added):
    @methods.register("shifted")
    def shifted(spark, sf_dir, given):
        return run(spark, "carry_forward", sf_dir, given).selectExpr("fold", "geo_value", "reference_date", "report_date", "prediction + 1 AS prediction")

    with pytest.raises(ValueError, match="already"):
        methods.register("shifted", "carry_forward")
    names = ("carry_forward", "shifted")
    rows = {r["method"]: r for r in methods.evaluate(spark, "method_availability", SF, names).collect()}
    assert set(rows) == set(names) and rows["shifted"]["probabilistic"] == 0 and rows["shifted"]["available"] == rows["carry_forward"]["available"]
    own = methods.long_table(spark, SF, names)
    assert own.where("method = 'shifted' AND abs(predicted_remaining_revision - 1) > 1e-9").isEmpty()
    twice = lambda spark, sf_dir, given: shifted(spark, sf_dir, given).unionByName(shifted(spark, sf_dir, given))
    methods.register("twice", twice)
    with pytest.raises(Exception, match="two forecasts"):
        methods.long_table(spark, SF, ("twice",)).collect()


def test_fits_beat_the_latest_value(spark):
    rows = {r["method"]: r for r in methods.method_scores(spark, SF).collect()}
    assert set(rows) == set(methods.METHODS)
    assert rows["quantile_global"]["mean_ae"] < rows["carry_forward"]["mean_ae"] and rows["quantile_global"]["mean_wis"] < rows["carry_forward"]["mean_wis"]
