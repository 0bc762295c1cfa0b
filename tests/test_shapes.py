"""Penalized curves and soft clusters against NumPy."""

import datetime as dt

import numpy as np

from tidemark.models import run
from tidemark.operators import clusters, smooth

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 1)


def test_the_basis_adds_up_to_one_and_bends_nowhere_for_lines():
    b = smooth.basis(np.linspace(0, 28, 57))
    assert b.shape == (57, 6) and np.allclose(b.sum(axis=1), 1) and (b >= 0).all() and b[0, 0] == 1 and b[-1, -1] == 1
    x = np.linspace(0, 28, 57)
    c = np.linalg.lstsq(b, 3 * x - 1, rcond=None)[0]
    assert np.allclose(b @ c, 3 * x - 1)


def test_curves_equal_numpy(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for e in range(30):
        lags = sorted({0, 28, *r.choice(28, r.integers(0, 9), replace=False).tolist()})
        y = np.cumsum(r.normal(size=len(lags)))
        rows += [("a", DAY + dt.timedelta(e), int(n), float(v)) for n, v in zip(lags, y)]
        b = smooth.basis(np.array(lags))
        d = np.diff(np.eye(6), n=2, axis=0)
        c = np.linalg.solve(b.T @ b + 1e-3 * d.T @ d + 1e-8 * np.eye(6), b.T @ y)
        want[DAY + dt.timedelta(e)] = y[-1] - smooth.basis(np.arange(29)) @ c
    knots = spark.createDataFrame(rows, "geo_value string, reference_date date, lag int, y double")
    got = run(spark, "episode_curves_bspline", given={"knots": knots}).collect()
    assert len(got) == 30 * 29
    assert all(abs(x["remaining"] - want[x["reference_date"]][x["lag"]]) < 1e-8 for x in got)
    # they stand for the other curves wherever those are read
    curves = run(spark, "location_curves", SF, given={"episode_curves": run(spark, "episode_curves_bspline", SF)})
    assert not curves.isEmpty()


def test_clusters_of_planted_groups(spark):
    r = np.random.default_rng(3)
    rows = []
    for fold in (1, 2):
        for i in range(12):
            z = np.array([0.0, 5.0, 10.0])[i % 3] + 0.1 * r.normal(size=5)
            rows += [(fold, f"g{i:02d}", 1, m, float(v)) for m, v in zip("abcde", z)]
    rows += [(1, g, 2, m, 1.0) for g in ("g00", "g01") for m in "abcde"]  # one profile: one cluster
    frame = spark.createDataFrame(rows, "fold int, geo_value string, band int, metric string, z double")
    got = clusters.memberships(frame).collect()
    member = {}
    for x in got:
        member.setdefault((x["fold"], x["band"], x["geo_value"]), {})[x["cluster"]] = x["membership"]
    assert all(abs(sum(m.values()) - 1) < 1e-12 for m in member.values())
    assert {len(m) for k, m in member.items() if k[1] == 2} == {1}
    for fold in (1, 2):
        own = [max(member[(fold, 1, f"g{i:02d}")], key=member[(fold, 1, f"g{i:02d}")].get) for i in range(12)]
        assert own[:3] * 4 == own and len(set(own)) == 3


def test_routes_are_memberships_times_their_transpose(spark):
    m = run(spark, "cluster_memberships", SF).collect()
    w = run(spark, "soft_cluster_routes", SF).collect()
    of = {}
    for x in m:
        of.setdefault((x["fold"], x["band"]), {}).setdefault(x["geo_value"], np.zeros(3))[x["cluster"] - 1] = x["membership"]
    for key, own in of.items():
        names = sorted(own)
        a = np.stack([own[g] for g in names])
        want = a @ a.T / (a @ a.T).sum(axis=1, keepdims=True)
        got = {(x["target"], x["source"]): x["weight"] for x in w if (x["fold"], x["band"]) == key}
        assert len(got) == len(names) ** 2
        assert all(abs(got[(names[i], names[j])] - want[i, j]) < 1e-9 for i in range(len(names)) for j in range(len(names)))
