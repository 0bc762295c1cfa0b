"""Donors weighed in reach against all donors, cold starts and origins without comparable donors."""

import numpy as np
import pytest

from tidemark.models import run
from tidemark.operators import donors

LEVELS = [float(t) for t in donors.TAUS]


def plain(case, given, scale, curves, distance, curve_scale, stage_scale):
    """One case against every donor of its origin."""
    fold, geo, lag, state = case
    rows = [(g, n, y, s) for f, g, n, y, s in given if f == fold and (state is None or s is not None)]
    part = lambda s: 0.0 if state is None else ((state - s) / scale) ** 2
    able = [(((distance[(geo, g)] / curve_scale) ** 2 + ((curves[(geo, lag)] - curves[(g, n)]) / stage_scale) ** 2 + part(s)), y) for g, n, y, s in rows if (geo, lag) in curves and (g, n) in curves]
    if not able:
        able = [((n - lag) ** 2 / 28**2 + part(s), y) for g, n, y, s in rows] or [((n - lag) ** 2 / 28**2, y) for f, g, n, y, s in given if f == fold]
    d2, y = np.array([a for a, _ in able]), np.array([b for _, b in able])
    order = np.argsort(y, kind="stable")
    w, y = np.exp(d2.min() - d2)[order], y[order]
    return w.sum() ** 2 / (w * w).sum(), (w * y).sum() / w.sum(), [y[np.searchsorted(np.cumsum(w), t * w.sum() - 1e-9 * w.sum())] for t in LEVELS]


def test_matches_equal_all_donors(spark, monkeypatch):
    monkeypatch.setattr(donors, "TOGETHER", 7)
    import datetime as dt

    r = np.random.default_rng(4)
    day = dt.date(2020, 1, 1)
    curves = {(g, n): float(abs(r.normal(scale=3))) for g in "abc" for n in range(29)}
    distance = {(g, h): 0.0 if g == h else float(abs(r.normal(scale=4))) for g in "abc" for h in "abc"}
    distance = {(g, h): max(distance[(g, h)], distance[(h, g)]) for g, h in distance}
    given = [(1, g, int(n), float(np.round(r.normal(), 2)), None if r.random() < 0.2 else float(r.normal())) for g in "abcz" for n in range(0, 29, 2) for _ in range(6)]
    given += [(2, "z", 3, float(i), None if i % 2 else float(i)) for i in range(8)] + [(3, "z", 5, 1.5, None), (3, "z", 9, 2.5, None)]
    cases = [(1, g, int(n), None if r.random() < 0.3 else float(r.normal(scale=3))) for g in "abcz" for n in (0, 3, 4, 28) for _ in range(9)]
    cases += [(2, "a", 4, 1.0), (2, "a", 4, None), (3, "a", 4, 1.0), (4, "a", 4, 1.0)]
    frame = spark.createDataFrame
    progress = frame([(f, g, day + dt.timedelta(i), day + dt.timedelta(i + n), n, 1.0, 0.5, s) for i, (f, g, n, s) in enumerate(cases)], "fold int, geo_value string, reference_date date, report_date date, lag int, truth double, latest double, progress double")
    got = donors.match(
        progress, frame([(f, g, n, p) for f in (1, 2, 3, 4) for (g, n), p in curves.items()], "fold int, geo_value string, lag int, position double"),
        frame([(f, g, h, d) for f in (1, 2, 3, 4) for (g, h), d in distance.items()], "fold int, geo_value string, donor_geo string, distance double"), frame([(f, 1.3) for f in (1, 2, 3, 4)], "fold int, curve_scale double"),
        frame([(f, 0.7) for f in (1, 2, 3, 4)], "fold int, stage_scale double"), frame([(f, g, day, n, y, s) for f, g, n, y, s in given], "fold int, geo_value string, reference_date date, lag int, remaining double, state double"),
        frame([(f, 0.9) for f in (1, 2, 3, 4)], "fold int, scale double"),
    ).collect()
    assert len(got) == len(cases)
    seen = set()
    for x in got:
        case = cases[(x["reference_date"] - day).days]
        if case[0] == 4:
            assert x["fallback"] == "no donors" and x["donors"] == 0 and x["q0_5"] is None
            continue
        even, mean, quantiles = plain(case, given, 0.9, curves, distance, 1.3, 0.7)
        assert x["effective_donors"] == pytest.approx(even, rel=1e-8) and x["mean_remaining"] == pytest.approx(mean, rel=1e-8, abs=1e-8)
        assert [x[q] for q in donors.QS] == pytest.approx(quantiles)
        seen.add(x["fallback"])
    assert seen == {"none", "cold start, state and lag", "cold start, lag", "no comparable donor, state and lag", "no comparable donor, lag"}


def test_every_lag_is_forecast(spark):
    sf = "/root/testdata/sf0.001"
    assert run(spark, "donor_forecast", sf).count() == run(spark, "build_cases", sf).count()
