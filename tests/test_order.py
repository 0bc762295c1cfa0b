"""Ranks, percentiles and draws of groups against NumPy and against one window."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import draws, order


@pytest.fixture
def rows(spark):
    r = np.random.default_rng(6)
    data = [(g, float(v), int(v * 2) % 3) for g, n in (("a", 700), ("b", 41), ("c", 1)) for v in np.round(r.normal(scale=5, size=n))]
    return spark.createDataFrame(data, "g string, x double, y int")


def test_ranks_equal_one_window(spark, rows, monkeypatch):
    monkeypatch.setattr(order, "SHARE", 10)  # some values are frequent, some are not
    w = Window.partitionBy("g")
    want = rows.select("g", "x", "y", *((F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("g", c)) - 1) / 2).alias(f"r{c}") for c in "xy"))
    got = order.ranked(rows, ["g"], {"x": "rx", "y": "ry"}).select("g", "x", "y", "rx", "ry")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pair = {r["g"]: r["c"] for r in got.groupBy("g").agg(order.correlation("rx", "ry").alias("c")).collect()}
    a = np.array([(r["rx"], r["ry"]) for r in got.where("g = 'a'").collect()])
    assert pair["a"] == pytest.approx(np.corrcoef(a.T)[0, 1]) and pair["c"] is None


def test_percentiles_equal_numpy(spark, rows):
    levels = {"low": 0.0, "q": 0.1, "half": 0.5, "most": 0.9, "high": 1.0}
    got = {r["g"]: r for r in order.percentiles(rows.unionByName(spark.createDataFrame([("a", None, 0), ("d", None, 0)], "g string, x double, y int")), ["g"], "x", levels).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        x = [r["x"] for r in rows.where(F.col("g") == g).collect()]
        assert [got[g][c] for c in levels] == pytest.approx([np.quantile(x, p) for p in levels.values()])


def test_draws_fall_in_proportion_and_equal_one_line(spark, monkeypatch):
    monkeypatch.setattr(draws, "STRETCH", 3)
    r = np.random.default_rng(1)
    day = dt.date(2020, 1, 1)
    data = [(1, "t", g, day + dt.timedelta(int(d)), int(n), float(w)) for g in "ab" for d in range(0, 90, 9) for n, w in zip((0, 2, 5), r.choice([0.0, 0.5, 1.0, 20.0], 3))]
    weights = spark.createDataFrame(data, "fold int, target string, geo_value string, reference_date date, lag int, weight double")
    groups = spark.createDataFrame([("0-3", 0, 3), ("4-7", 4, 7)], "lag_group string, lo int, hi int")
    got = draws.resample(weights, groups).collect()
    from hashlib import md5

    for name, lo, hi in (("0-3", 0, 3), ("4-7", 4, 7)):
        own = sorted((x for x in data if lo - 1 <= x[4] <= hi + 1), key=lambda x: x[2:5])
        ends = np.cumsum([round(x[5] * 1e6) for x in own])
        want = {}
        for place in range(1, len(own) + 1):
            spot = int(md5(f"resample:1:{name}:t:{place}".encode()).hexdigest()[:12], 16) % int(ends[-1])
            want[place] = own[int(np.searchsorted(ends, spot, side="right"))][2:5]
        assert {x["draw"]: (x["geo_value"], x["reference_date"], x["lag"]) for x in got if x["lag_group"] == name} == want
