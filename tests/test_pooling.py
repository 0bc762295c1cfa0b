"""Splines, searches, components and pools against plain sequential versions."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.models import run
from tidemark.operators import episodes, pools, search


def test_spline_equals_a_dense_solve(spark):
    r = np.random.default_rng(2)
    grid = np.arange(29.0)
    for n in (2, 3, 4, 9, 20):
        x = np.sort(r.choice(29, n, replace=False)).astype(float)
        y = r.normal(size=n)
        if n == 2:
            want = np.interp(grid, x, y)
        else:  # coefficients of every piece from one dense system
            a, b = np.zeros((4 * (n - 1),) * 2), np.zeros(4 * (n - 1))
            row = 0
            for k in range(n - 1):
                for at, value in ((0.0, y[k]), (x[k + 1] - x[k], y[k + 1])):
                    a[row, 4 * k : 4 * k + 4], b[row] = [1, at, at**2, at**3], value
                    row += 1
            for k in range(n - 2):
                h = x[k + 1] - x[k]
                a[row, 4 * k : 4 * k + 4], a[row, 4 * k + 5] = [0, 1, 2 * h, 3 * h * h], -1
                a[row + 1, 4 * k : 4 * k + 4], a[row + 1, 4 * k + 6] = [0, 0, 2, 6 * h], -2
                row += 2
            h = x[-1] - x[-2]
            a[row, 2], a[row + 1, -2:] = 2, [2, 6 * h]
            c = np.linalg.solve(a, b).reshape(-1, 4)
            k = np.clip(np.searchsorted(x, grid, side="right") - 1, 0, n - 2)
            want = sum(c[k, p] * (grid - x[k]) ** p for p in range(4))
        assert np.allclose(episodes.natural_spline(x, y, grid), want, atol=1e-8)


def test_summary_of_an_episode(spark):
    day = dt.date(2020, 1, 1)
    data = [("a", day, lag, y) for lag, y in ((0, 1.0), (3, 1.5), (10, 1.5), (12, 1.0), (28, 4.0))]
    knots = spark.createDataFrame(data, "geo_value string, reference_date date, lag int, y double")
    got = {r["lag"]: r for r in run(spark, "episode_summaries", given={"episode_knots": knots}).collect()}
    assert set(got) == {0, 3, 10, 12}
    assert (got[0]["releases"], got[0]["median_gap"], got[0]["zero_share"]) == (4, 5.0, 0.25)
    assert (got[0]["median_step"], got[0]["median_abs_step"], got[0]["mad_step"]) == (0.25, 0.5, pytest.approx(0.5))
    assert (got[12]["releases"], got[12]["median_gap"], got[12]["median_step"], got[12]["mad_step"]) == (1, 16.0, 3.0, 0.0)


def plain_walk(tasks, distance, limit):
    """Each search as a loop: tasks as (geo, lag)."""
    of = {}
    for g, n in sorted(tasks):
        of.setdefault(g, []).append(n)
    seen = set()
    for g, n in tasks:
        for other, lags in of.items():
            if other == g:
                for way in (1, -1):
                    misses, at = 0, lags.index(n) + way
                    while 0 <= at < len(lags) and misses < 2:
                        seen.add((g, n, other, lags[at]))
                        misses = 0 if distance((g, n), (other, lags[at])) <= limit else misses + 1
                        at += way
                continue
            center = n in lags
            if center:
                seen.add((g, n, other, n))
            up, down = [x for x in lags if x > n], [x for x in lags if x < n][::-1]
            for path in (up, down):
                best, before = (distance((g, n), (other, n)) if center else float("inf")), False
                for i, x in enumerate(path):
                    d = distance((g, n), (other, x))
                    seen.add((g, n, other, x))
                    if center and i == 0:
                        if not d < best:
                            break
                    elif d > limit and before and not d < best:
                        break
                    best, before = min(best, d), d > limit
    return seen


def test_walks_equal_loops(spark):
    r = random.Random(5)
    rows, limits, scales, want = [], [], [], {}
    for fold in range(4):
        tasks = {(g, n) for g in "abc" for n in range(12) if r.random() < 0.8}
        vector = {t: [float(r.choice((0, 0, 1, 2, 4)))] * 5 for t in tasks}
        places = {}
        for g, n in sorted(tasks):
            places[(g, n)] = sum(x == g for x, _ in places)
            rows.append((fold, g, n, places[(g, n)], vector[(g, n)], [0.0] * (13 - n), 0.0))
        distance = lambda s, t, v=vector: round(5**0.5 * abs(v[s][0] - v[t][0]), 6)
        limits.append((fold, 2.5 * (1 + fold % 2), len(tasks)))
        scales.append((fold, 1.0, 1.0, 1.0))
        want |= {(fold, *q): distance((q[0], q[1]), (q[2], q[3])) for q in plain_walk(tasks, distance, limits[-1][1])}
    frame = spark.createDataFrame(rows, "fold int, geo_value string, lag int, place int, profile array<double>, course array<double>, stage double")
    got = search.walk(frame, spark.createDataFrame(scales, "fold int, d_profile double, d_course double, d_stage double"), spark.createDataFrame(limits, "fold int, threshold double, tasks long")).collect()
    assert {(x["fold"], x["geo_value"], x["lag"], x["other_geo"], x["other_lag"]): x["distance"] for x in got} == want and len(got) == len(want)


def plain_pools(n, near, limit):
    """The whole graph at once: the least entry of a matrix of pools, again and again."""
    m = np.full((n, n), np.inf)
    for (i, j), d in near.items():
        if d <= limit:
            m[i, j] = m[j, i] = d
    member = {i: [i] for i in range(n)}
    while np.isfinite(m.min(initial=np.inf)):
        a, b = sorted(divmod(int(np.argmin(m)), n))
        m[a] = m[:, a] = np.maximum(m[a], m[b])
        m[b] = m[:, b] = np.inf
        m[a, a] = np.inf
        member[a] += member.pop(b)
    return sorted(map(sorted, member.values()))


def graph(r, n):
    return {(i, j): r.choice((0.0, 0.0, 0.1, 0.5, 1.0)) for i in range(n) for j in range(i + 1, n) if r.random() < r.choice((0.1, 0.4))}


def test_linkage_in_components_is_that_of_the_whole():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(2, 16)
        near = graph(r, n)
        first = pools.linkage(n, {k: d for k, d in near.items() if d <= 0.5})
        got = sorted([i for i in range(n) if first[i] == f] for f in set(first))
        assert got == plain_pools(n, near, 0.5)
        # and component by component
        label = list(range(n))
        for _ in range(n):
            for (i, j), d in near.items():
                if d <= 0.5:
                    label[i] = label[j] = min(label[i], label[j])
        apart = []
        for c in set(label):
            own = [i for i in range(n) if label[i] == c]
            f = pools.linkage(len(own), {(own.index(i), own.index(j)): d for (i, j), d in near.items() if d <= 0.5 and i in own and j in own})
            apart += [[own[i] for i in range(len(own)) if f[i] == x] for x in set(f)]
        assert sorted(map(sorted, apart)) == got


def test_pools_of_many_origins(spark):
    r = random.Random(9)
    tasks, edges, want = [], [], {}
    for fold in range(6):
        n = r.randrange(5, 25)
        names = sorted((r.choice("ab"), i) for i in range(n))
        near = {(i, i + 1): 0.0 for i in range(n - 1)} if fold == 0 else graph(r, n)  # a long chain too
        tasks += [(fold, g, x) for g, x in names]
        edges += [(fold, *names[i], *names[j], d) for (i, j), d in near.items()]
        want[fold] = [sorted(names[i] for i in p) for p in plain_pools(n, near, 0.5)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = pools.coherent(frame(tasks, "fold int, geo_value string, lag int"), frame(edges, "fold int, a_geo string, a_lag int, b_geo string, b_lag int, distance double"), frame([(f, 0.5) for f in want], "fold int, threshold double")).collect()
    for fold, own in want.items():
        found = {}
        for x in got:
            if x["fold"] == fold:
                found.setdefault(x["pool"], []).append((x["geo_value"], x["lag"]))
        assert [sorted(found[k]) for k in sorted(found)] == own


def test_pools_of_the_tables_hold_their_diameter(spark):
    sf = "/root/testdata/sf0.001"
    p, d = run(spark, "coherent_pools", sf), run(spark, "task_distance", sf)
    limits = run(spark, "nearest_threshold", sf)
    assert p.count() == run(spark, "task_prototypes", sf).count()
    both = p.selectExpr("fold", "geo_value AS a_geo", "lag AS a_lag", "pool").join(p.selectExpr("fold", "geo_value AS b_geo", "lag AS b_lag", "pool"), ["fold", "pool"]).where("a_geo < b_geo OR a_geo = b_geo AND a_lag < b_lag")
    checked = both.join(d, ["fold", "a_geo", "a_lag", "b_geo", "b_lag"], "left").join(limits, "fold")
    assert checked.where("distance IS NULL OR distance > threshold").isEmpty() and not checked.isEmpty()
    sets = run(spark, "train_sets_pooled", sf)
    small = sets.groupBy("fold", "pool", "trains_on").count().where("count < 10 AND trains_on <> 'all'")
    assert small.isEmpty()
